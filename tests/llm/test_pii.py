import random

from pyspark.sql import functions as F

from tracewright.llm import pii


def _model():
    if not hasattr(_model, "m"):
        _model.m = pii.train()
    return _model.m


def test_sentences_of_the_same_frames():
    data = pii.training_set(1200, seed=99)
    wrong = [t for t, g in data if set(_model().decode(t)) != g]
    assert len(wrong) <= 70, wrong


# Written apart from the module: none of these names, numbers, streets or sentences stands in it or in the test tables.
APART = [
    ("licensed to Priya Raghunathan", "person", "Priya Raghunathan"), ("thanks to Jennifer Aniston for the patch", "person", "Jennifer Aniston"), ("licensed to Wei Zhang", "person", "Wei Zhang"),
    ("Report filed by Themba Ndlovu, closed", "person", "Themba Ndlovu"), ("Dear Mrs. Amelia Earhart, your ticket is ready", "person", "Mrs. Amelia Earhart"), ("signed: J. R. Hartley", "person", "J. R. Hartley"),
    ("contact Saoirse Gallagher, +353 1 496 0123", "person", "Saoirse Gallagher"), ("Lovelace, Ada", "person", "Lovelace, Ada"), ("author: Grace B. Hopper", "person", "Grace B. Hopper"), ("Danke an Herr Thomas Brandt", "person", "Herr Thomas Brandt"),
    ("merge requested by Aiko Tanaka", "person", "Aiko Tanaka"), ("负责人:诸葛孔明,已确认", "person", "诸葛孔明"), ("maintainer: Bjarne Stroustrup <bs@lang.example>", "person", "Bjarne Stroustrup"), ("maria oldenburg wrote this", "person", "maria oldenburg"),
    ("call (415) 555-2671", "phone", "(415) 555-2671"), ("ring me at +353 1 496 0123 please", "phone", "+353 1 496 0123"), ("number: 020 7183 8750", "phone", "020 7183 8750"), ("reach the office under 089 / 123456-78", "phone", "089 / 123456-78"),
    ("dial 0081 3 5555 0143", "phone", "0081 3 5555 0143"), ("my cell is 212-867-5309", "phone", "212-867-5309"), ("tel 06 12 34 56 78 svp", "phone", "06 12 34 56 78"), ("whatsapp +5511987654321", "phone", "+5511987654321"),
    ("write to ada.l@analytical.example today", "email", "ada.l@analytical.example"), ("ping root (at) kernel.example for keys", "email", "root (at) kernel.example"), ("it is bob [at] builders [dot] example", "email", "bob [at] builders [dot] example"), ("alice AT wonder DOT example", "email", "alice AT wonder DOT example"),
    ("social security number: 078-05-1120", "id_number", "078-05-1120"), ("my passport no. is broken: passport no. C03005988", "id_number", "C03005988"), ("DNI 12345678Z checked", "id_number", "12345678Z"), ("NI number AB 12 34 56 C on file", "id_number", "AB 12 34 56 C"),
    ("ID card no. 12345", "id_number", "12345"), ("id card: 12 345", "id_number", "12 345"), ("身份证 110101199003078515 已上传", "id_number", "110101199003078515"), ("Führerschein Nr. B072RRE2I55 lost, Steuer-ID 86 095 742 719", "id_number", "86 095 742 719"),
    ("deliver to 221b Baker Street, London", "address", "221b Baker Street, London"), ("he lives at 1600 Pennsylvania Avenue, Washington 20500", "address", "1600 Pennsylvania Avenue, Washington 20500"), ("Adresse: Lindwurmstraße 12a, 80337 München", "address", "Lindwurmstraße 12a, 80337 München"),
    ("rendez-vous 12 rue de Rivoli, 75004 Paris", "address", "12 rue de Rivoli, 75004 Paris"), ("Calle de Alcalá 48, 28014 Madrid", "address", "Calle de Alcalá 48, 28014 Madrid"), ("地址:上海市浦东新区世纪大道100号", "address", "上海市浦东新区世纪大道100号"),
]
CLEAN = [
    "Crimson Hydra joined the arena", "renamed Frozen Citadel to Emerald Bastion", "Loading Vulkan Backend 1.3.280", "slain by Obsidian Wyvern", "took 1234567 ns in 12 calls", "player at -1234.5, 64.0, 987.1", "commit 9fceb02d0ae598e95dc970b74767f19372d61af8",
    "2031-02-03 04:05:06.789 heartbeat", "1769876543210|INFO|pool-3|svc|ok", "build 2024.11.05-1432 ok", "Unity Engine started", "jar foo-1.2.3.jar@4.5", "java.util.NoSuchElementException: 42", "Fixed ZipException in RegionLoader", "seed 4723984723984723", "ip 192.168.100.200:25565",
    "uuid 123e4567-e89b-12d3-a456-426614174000", "Copper Golem Statue placed", "memory 16777216/33554432", "range 10000-20000", "tax applied: 12%", "insurance of the Iron Wagon", "Opened Trade Route menu", "The Silent Reef was discovered",
]


def test_what_was_written_apart():
    missed = [(t, s, k) for t, k, s in APART if (s, k) not in {(t[a:b], x) for a, b, x in _model().decode(t)}]
    assert len(missed) <= 0.1 * len(APART), missed
    wrong = [(t, [(t[a:b], k) for a, b, k in _model().decode(t)]) for t in CLEAN if _model().decode(t)]
    assert len(wrong) <= 1, wrong


def test_heads_of_log_lines_are_read():
    for t, want in (("[12:00:00] [anna.kellquist@example.org]: hello", "email"), ("[12:00:00] [Anna Kellquist/INFO]: hi", "person"), ('{"t":"2025-01-02T03:04:05Z","user":"a.b@example.org","msg":"x"}', "email")):
        assert [k for _, _, k in _model().decode(t)] == [want], t


def test_no_persons_in_names_of_things():
    for t in ("renamed Gilded Husk to Silver Lantern", "gave 41 Oak Planks to turbo_comet9", "waypoint 'Hollow Regent Street Station' saved", "pipe length 90 Copper Road segments", "session id -6261998634554933031 expired", "jar-in-jar stonefen@0.1.1.jar shadowed", "region window 555, 014, 2233 cleared"):
        assert _model().decode(t) == [], t


def test_boundaries_and_types_are_chosen_together():
    t = "send the badge to Marta K. Lindova, 12 Miller's Lane, Ostbury 00381"
    assert [(t[a:b], k) for a, b, k in _model().decode(t)] == [("Marta K. Lindova", "person"), ("12 Miller's Lane, Ostbury 00381", "address")]


def test_decode_is_the_best_segmentation():
    t, m = "Co-owner Emma Stone, mail jonas@example.org, phone +49 30 23125 281, SSN 912-67-4257", _model()
    c = pii.candidates(t)
    best, pick = 0.0, []
    for mask in range(1, 1 << len(c)):
        own = sorted((c[i] for i in range(len(c)) if mask >> i & 1), key=lambda x: (x[0], x[1]))
        if all(a[1] <= b[0] for a, b in zip(own, own[1:])):
            v = sum(m.score(x[3]) for x in own) + sum(m.score(m.between(t, a, b)) for a, b in zip(own, own[1:]))
            if v > best:
                best, pick = v, [x[:3] for x in own]
    assert m.decode(t) == pick and len(pick) == 4


def test_gradient_is_that_of_the_likelihood():
    t, gold = "Contact: Emma Stone, +49 30 23125 281", {(9, 19, "person"), (21, 37, "phone")}
    m = pii.SemiCRF({f: 0.1 for c in pii.candidates(t) for f in c[3]} | {"person>phone": 0.2})
    g: dict = {}
    base = m.gradient(t, gold, g)
    for f in ("person>phone", "phone:start_plus", "person:bias"):
        m.w[f] = m.w.get(f, 0.0) + 1e-4
        assert abs((m.gradient(t, gold, {}) - base) / 1e-4 - g[f]) < 1e-2, f
        m.w[f] -= 1e-4


def test_native_gates_are_those_of_the_candidates(spark):
    """A text without a gate has no candidate, and Spark sees the same gates: over sentences and random pieces."""
    r = random.Random(5)
    pieces = ["SSN ", "social security number: ", "identity card ", "ID card no. ", "führerschein nr. ", "FÜHRERSCHEIN ", "12-345", "1234567", "12 345", "2025-01-02 03:04:05", "1745227898759|INFO|", " at ", "(at)", "x.y", " dot ", "@", "anna", "Anna", " ", "\t", "\n", "\u2028", "Weber", "J.", ", ", "路5", "ул. ", "rue ", "weg 3", "Calle ", "诸葛", "亮", "王伟", "ſ", "İ", "K", "٣٣٣٣٣٣٣", "é", "Street", "12 High "]
    texts = [t for t, _ in pii.training_set(1500, seed=3)] + ["", "x" * 50_000, *("".join(r.choice(pieces) for _ in range(r.randint(1, 9))) for _ in range(4000))]
    texts = list(dict.fromkeys(texts))
    passed = {x.t for x in spark.createDataFrame([(t,) for t in texts], "t string").where(pii.may_hold(F.col("t"))).collect()}
    assert [t for t in texts if t not in passed and any(pii.gates(x) for x in t.splitlines())] == []
    assert [t for t in texts if not pii.gates(t) and pii.candidates(t)] == []
    assert [t for t in texts if t in passed and not pii.gates(t)] == []


def test_redaction_and_edges(spark):
    rows = [
        ("a", 1, "contact=jonas@example.org attempts=3\nplain line\r\ncall me on +49 30 23125 281 if"),
        ("a", 1, "contact=jonas@example.org attempts=3\nplain line\r\ncall me on +49 30 23125 281 if"),
        ("a", 2, None), ("a", 3, ""), ("a", 4, "nothing here"), ("a", 5, "y " * 100_000 + "contact=jonas@example.org attempts=3"),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "source string, rec_id long, text string, kinds string, redacted int")
    out = {r.rec_id: r for r in pii.redact(df, _model()).collect()}
    assert set(out) == {1, 5} and out[1].kinds == ["email", "phone"]
    assert out[1].redacted == "contact=<EMAIL> attempts=3\nplain line\r\ncall me on <PHONE> if" and out[5].redacted.endswith("contact=<EMAIL> attempts=3")
    assert pii.redact(df.limit(0), _model()).count() == 0
