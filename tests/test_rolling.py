import random

from tracewright.operators.rolling import TwoStackQueue, rolling_totals

SCHEMA = "ts double, uid string, session_id string, input bigint, output bigint, source string"


def test_queue_against_brute_force():
    r = random.Random(3)
    for op, unit in ((lambda a, b: a + b, 0), (max, -1), (lambda a, b: a + b, "")):
        q, kept, pos = TwoStackQueue(op, unit), [], 0
        for _ in range(500):
            pos += r.randint(0, 2)
            v = r.choice("abc") if unit == "" else r.randint(0, 99)
            q.evict_before(pos - 5)
            kept = [x for x in kept if x[0] >= pos - 5]
            q.push(pos, v)
            kept.append((pos, v))
            want = unit
            for _, x in kept:
                want = op(want, x)
            assert q.total() == want


def test_units_gaps_and_dirty_rows(spark):
    day = 1_740_000_000 // 86400 * 86400.0
    rows = [
        (day + 5, " u1 ", "s", 10, 1, "a"),
        (day + 5, " u1 ", "s", 10, 1, "a"),  # a whole row twice
        ((day + 86400 * 9) * 1000, "u1", "s", None, 3, "a"),  # milliseconds, null amount
        ((day + 86400 * 10) * 1e6, "u1", "s", 0, 0, "a"),  # microseconds, no tokens
        (0.0, "u1", "s", 5, 5, "a"),
        (None, "u1", "s", 5, 5, "a"),
        (day, None, "s", 5, 5, "a"),
        (day, "  ", "s", 5, 5, "a"),
    ]
    out = rolling_totals(spark.createDataFrame(rows, SCHEMA)).orderBy("day").collect()
    assert len(out) == 11 and {r.entity for r in out} == {"u1"}
    assert [r.input_7 for r in out] == [10] * 7 + [0] * 4
    assert [r.output_7 for r in out] == [1] * 7 + [0, 0, 3, 3]
    assert out[-1].input_30 == 10 and out[-1].max_total_30 == 11 and out[-1].calls == 1
    assert abs(out[0].avg_input_7 - 10 / 7) < 1e-12


def test_empty_and_clashing_names(spark):
    assert rolling_totals(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1.74e9, "u", "s", 1, 1, "a", 7, 8)], SCHEMA + ", entity int, day int")
    assert [r.input_30 for r in rolling_totals(df).collect()] == [1]
