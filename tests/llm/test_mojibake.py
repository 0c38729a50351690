from pathlib import Path

import pyarrow.parquet as pq
import pytest

from tracewright import session
from tracewright.llm import mojibake as M

SOUND = [
    "Beim Öffnen des Inventars friert das Spiel für etwa {} Sekunden ein und schließt sich.", "Après la mise à jour, la mémoire dépasse {} Mo en quelques minutes.", "Sempre que abro o inventário, não há {} receitas.",
    "После обновления сервер пишет, что не хватает {} модов, хотя он установлен.", "更新之后,服务器说缺少{}个模组,可是明明已经装好了。", "サーバーに入ると、{}秒ほど固まってから落ちます。", "업데이트한 뒤 몇 분 만에 메모리가 {}MB를 넘습니다.",
    "Temperature {} °C, load ½", "price {} €, bonus ±3 ×2", "» Marsh « joined · {} online", "§cWarnung:§r fehlt {}", "OPÇÃO {}: MAÇÃ", "╔══ Mod {} ══╗ ready", "λ → μ reload, Ω = {}",
]
CHAINS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "gb18030"), ("cp1251", "cp1252"), ("gb18030", "latin-1"), ("cp949", "latin-1"), ("utf-8", "cp1251"), ("koi8_r", "cp1251")]


def _damage(text, written, read):
    try:
        return text.encode(written).decode(read)
    except UnicodeError:
        return None


def _planted():
    rows = []
    for k, s in enumerate(SOUND):
        for n in range(40):
            rows.append((s.format(n), s.format(n), False))
        for n in range(40, 52):
            t = s.format(n)
            bad = _damage(t, *CHAINS[(n + k) % len(CHAINS)])
            if bad and bad != t and not bad.isascii():
                rows.append((bad, t, True))
    return rows


def test_planted_damage_is_found_and_undone(spark):
    rows = _planted() + [("caf� lost", "caf� lost", True)]
    df = spark.createDataFrame([("s", i, t, 0, "c") for i, (t, _, _) in enumerate(rows)], "source string, rec_id long, text string, damaged int, chain string")
    out = {r.rec_id: r for r in M.repair(df).collect()}
    found = {i for i, r in out.items() if r.damaged}
    true = {i for i, x in enumerate(rows) if x[2]}
    assert len(found & true) >= 0.95 * len(true) and len(found - true) <= 0.02 * len(rows)
    assert sum(out[i].restored == rows[i][1] for i in true) >= 0.85 * len(true)
    assert all(out[i].restored == rows[i][0] for i in out if i not in found and i not in true)


def test_edges(spark):
    df = spark.createDataFrame([("s", 1, None), ("s", 2, ""), ("s", 3, "plain"), ("s", 4, "Der Spielstand lässt sich öffnen, größer als vorher. " * 3000), ("s", 4, "Der Spielstand lässt sich öffnen, größer als vorher. " * 3000)], "source string, rec_id long, text string")
    assert [(r.rec_id, r.damaged) for r in M.repair(df).collect()] == [(4, False)]
    assert M.repair(df.limit(0)).count() == 0


def test_part_of_a_text():
    m = M._start()
    assert M.posterior("la mémoire dÃ©passe", "s", m)[1] == "la mémoire dépasse"
    assert M.posterior("Со вчерашнеãî âå÷åðà", "s", m)[1] == "Со вчерашнего вечера"


def test_damage_below_ornaments_and_undecodable_bytes():
    m = M._start()
    bad = "更新之后,服务器说缺少模组".encode("gb18030").decode("cp1252", "replace")
    for text in (f"Temperature 5 °\n» Marsh «\n{bad}\nla mémoire", f"price ½ {bad}", f"» Marsh «\r\n{bad}\r\n± 3"):
        chain, fixed, p = M.posterior(text, "s", m)
        assert fixed == text.replace(bad, "更新之后,服务器说缺少模组") and p > 0.5, fixed


def test_lines_of_one_record_take_different_chains():
    m = M._start()
    a, b, c = "更新之后,服务器说缺少模组", "После обновления сервер пишет", "la mémoire dépasse déjà"
    text = "\n".join([a.encode("gb18030").decode("latin-1"), "x", b.encode("cp1251").decode("cp1252"), c.encode("utf-8").decode("cp1252")])
    chain, fixed, p = M.posterior(text, "s", m)
    assert fixed == "\n".join([a, "x", b, c]) and p > 0.5
    assert set(chain.split(M.BOTH)) == {"cp1252|gb18030", "cp1252|cp1251", "cp1252|utf-8"}


# Sound sentences of many languages; none is of the test tables.
RIGHT = [
    "don’t panic – it’s “fine”", "l’été déjà passé à la plage", "Grüße aus München – wir …", "Íslenska þjóðin", "Ærø og Ålesund", "Ελλάδα", "Η Ελλάδα είναι ωραία χώρα", "İstanbul’da güneş çok sıcak",
    "Łódź jest pięknym miastem", "Szczęście przychodzi, gdy się śmiejesz", "Tūkstančiai žmonių", "你好，世界！", "Это — «просто» тест…", "„Guten Tag“, sagte er", "100 € – 50 %", "naïve café ☕ 🎮", "Côté où ça",
    "Ñandú ¿Qué tal? ¡Bien!", "Việt Nam đẹp lắm", "שלום עולם", "مرحبا بالعالم", "สวัสดี", "A ≠ B ∧ C → D", "»Zitat« und ‚einfach‘", "Él está aquí, sí", "O’Brien’s", "ÄÖÜ GROSS", "МОСКВА", "½ Liter ± 3 µm²", "• Punkt · Mitte",
    "À bientôt", "être ou ne pas être, là où", "não há ação às vezes", "Ich weiß’s – „ja“", "Dvořák žije v Brně", "Gülşen’in evi", "Køb mælk på øen", "Тарас’ дім – «тут»", "電話 03-1234", "이름: 홍길동…",
]


def test_sound_texts_stay_as_they_are(spark):
    m = M._start()
    assert [(t, M.posterior(t, "s", m)) for t in RIGHT if M.posterior(t, "s", m)[1] != t or M.posterior(t, "s", m)[2] > 0.5] == []
    rows = _planted()
    n = len(rows)
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate([r[0] for r in rows] + RIGHT)], "source string, rec_id long, text string")
    out = {r.rec_id: r for r in M.repair(df).where(f"rec_id >= {n}").collect()}
    assert [t for i, t in enumerate(RIGHT, n) if out[i].damaged or out[i].restored != t] == []


def test_damage_that_leaves_ascii_only():
    m = M._start()
    assert M.posterior("h\0e\0l\0l\0o\0", "s", m)[:2] == ("latin-1|utf-16-le", "hello")
    assert M.posterior("Gr+APwA3w-e", "s", m)[:2] == ("ascii|utf-7", "Grüße")
    assert M.posterior("caf\ufffd lost", "s", m)[0] == "lost"


def test_rounds_settle_and_counts_are_soft(spark):
    df = spark.createDataFrame([("s", i, t) for i, (t, _, _) in enumerate(_planted())], "source string, rec_id long, text string")
    blobs = M.stage_table(df.mapInPandas(M._blobs, M._ARRAYS + ", texts string"), "t")
    a, b = M.fit(blobs, 8), M.fit(blobs, 30)
    assert a.shares.keys() == b.shares.keys() and abs(a.share("s", "sound") - b.share("s", "sound")) < 1e-9
    assert any(0.01 < n % 1 < 0.99 for n in a.shares["s"].values())


def test_few_rows_of_megabytes_are_held_at_once(spark):
    # Each text fills a row of its own; up to 100 of them were one row group before.
    texts = {i: f"é{'ab ' * 140_000}{i}é" for i in range(5)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        out = M.repair(spark.createDataFrame([("s", i, t) for i, t in texts.items()], "source string, rec_id long, text string"), rounds=0)
        assert {r.rec_id: r.restored for r in out.collect()} == texts
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    path = session._STAGED[-1][1].removeprefix("file:")
    parts = [pq.ParquetFile(p).metadata for p in Path(path).glob("*.parquet")]
    groups = [m.row_group(k) for m in parts for k in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 5 and max(g.num_rows for g in groups) <= 4


@pytest.mark.parametrize(("letters", "size"), [(40, 2), (300, 4)])
def test_places_of_pairs_take_two_bytes_or_four(letters, size):
    han = [chr(0x4E00 + i) for i in range(letters)]
    text = "".join(a + b for a in han for b in han)
    blob = M._Blob()
    blob.add("s", 1, text)
    row = blob.row()
    p = M._Posterior(row, M._start())
    assert len(row["seq"]) == size * sum(blob.lengths)
    first = f" {text} "
    assert p.keys[p.seq[: p.lengths[0]]].tolist() == [M.pair_key(first[i : i + 2]) for i in range(len(first) - 1)]
