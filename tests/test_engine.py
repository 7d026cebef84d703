import datetime
import random
import uuid

import duckdb
import pytest
from millrace import errors as E
from millrace import testdata
from millrace.catalog import Catalog, Entity, Index
from millrace.session import Session
from pyspark.sql.types import IntegerType, LongType, StructField, StructType


@pytest.fixture
def make(spark, tmp_path):
    """A session over tables given as name: (ddl, id, sequence, rows)."""

    def build(**tables):
        catalog = Catalog()
        for name, (ddl, key, sequence, rows) in tables.items():
            schema = StructType.fromDDL(ddl)
            path = str(tmp_path / name)
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)
            catalog.register(Entity(name, schema, id=key, sequence=sequence, path=path))
        return Session(spark, catalog)

    return build


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


NULLS = ("id long, k string, v int", "id", (), [(1, "a", 1), (2, "a", None), (3, None, 3), (4, "b", None)])


def test_nulls(make):
    s = make(t=NULLS)
    ids = lambda where: [r[0] for r in values(s.execute(f"SELECT id FROM t WHERE {where}"))]
    assert ids("k = 'a'") == [1, 2] and ids("k <> 'a'") == [4] and ids("k NOT IN ['a']") == [4]
    assert ids("k like 'a'") == [1, 2] and ids("k not like 'a'") == [4]
    assert ids("v IS NULL") == [2, 4] and ids("k IS NOT NULL AND v IS NOT NULL") == [1]
    assert ids("k = ''") == []
    assert values(s.execute("SELECT k, COUNT(v) n, COUNT(*) rows, SUM(v) s FROM t GROUP BY k")) == [("a", 1, 2, 1), ("b", 0, 1, None), (None, 1, 1, 3)]
    assert values(s.execute("SELECT COUNT(v) n FROM t WHERE id > 100")) == [(0,)]


def test_not_in_select_and_nulls(make):
    s = make(t=NULLS, u=("x int", None, (), [(1,), (7,)]), n=("x int", None, (), [(1,), (None,)]), e=("x int", None, (), []))
    ids = lambda table, word: [r[0] for r in values(s.execute(f"SELECT id FROM t WHERE v {word} [SELECT x FROM {table}]"))]
    assert ids("u", "NOT IN") == [3] and ids("n", "NOT IN") == [] and ids("e", "NOT IN") == [1, 2, 3, 4]
    assert ids("u", "IN") == [1] and ids("n", "IN") == [1] and ids("e", "IN") == []


def test_like_has_no_wildcards_and_names_may_hold_keywords(make):
    s = make(l=("id long, s string", "id", (), [(1, "a%b"), (2, "a_b"), (3, "axb")]), n=("id long, min int, inner string", "id", (), [(1, 5, "in"), (2, 6, "out")]))
    assert values(s.execute("SELECT id FROM l WHERE s like 'a%b'")) == [(1,)]
    assert values(s.execute("SELECT id, min FROM n WHERE min = 5 AND n.inner = 'in'")) == [(1, 5)]


def test_integer_average_truncates_toward_zero(make):
    s = make(t=("id long, k string, v int, d double", "id", (), [(1, "a", -7, -7.0), (2, "a", 0, 0.0)]))
    assert values(s.execute("SELECT k, AVG(v) m, AVG(d) e FROM t GROUP BY k")) == [("a", -3, -3.5)]


def test_inner_joins_drop_unmatched_rows_and_nulls(make):
    s = make(a=("x long, name string", "x", (), [(1, "p"), (2, "q"), (None, "r")]), b=("y long, name string", "y", (), [(2, "s"), (3, "t"), (None, "u")]))
    assert values(s.execute("SELECT x, a.name one, b.name two FROM a, b WHERE x = y")) == [(2, "q", "s")]
    with pytest.raises(E.AmbiguousColumnName):
        s.execute("SELECT name FROM a, b WHERE x = y")


def test_connected_tables_join_before_crossing(spark, sf):
    plan = testdata.session(spark, sf).execute("SELECT n_name FROM nation, lineitem, customer, orders WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in text and text.count("Join Inner") == 3


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = testdata.session(spark, sf).execute("SELECT o_orderkey FROM orders WHERE o_custkey = 7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,7)" in plan and "o_comment" not in plan and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("SELECT x FROM orders", E.InvalidColumnDescription),
        ("SELECT o_orderkey FROM nothing", E.InvalidTableDescription),
        ("SELECT *, o_orderkey FROM orders", E.InvalidColumnDescription),
        ("SELECT * FROM orders, nation", E.InvalidColumnDescription),
        ("SELECT z.o_orderkey FROM orders", E.InvalidColumnDescription),
        ("SELECT o_orderkey FROM orders WHERE o_orderkey = 'x'", E.InvalidConditionValue),
        ("SELECT o_orderkey FROM orders WHERE o_orderstatus = 5", E.InvalidConditionValue),
        ("SELECT o_orderkey FROM orders WHERE o_orderdate = 5", E.InvalidConditionValue),
        ("SELECT o_orderkey FROM orders WHERE o_orderkey = o_orderstatus", E.InvalidCondition),
        ("SELECT o_orderkey FROM orders WHERE o_orderkey like 'a'", E.InvalidCondition),
        ("SELECT o_orderkey FROM orders GROUP BY o_orderkey", E.InvalidGroupColumnSet),
        ("SELECT o_orderkey, COUNT(*) n FROM orders", E.InvalidGroupColumnSet),
        ("SELECT COUNT(*) n FROM orders GROUP BY o_orderkey", E.InvalidGroupColumnSet),
        ("SELECT o_custkey, o_orderkey, COUNT(*) n FROM orders GROUP BY o_orderkey", E.InvalidGroupColumnSet),
        ("SELECT o_custkey, COUNT(*) n FROM orders GROUP BY nothing", E.InvalidGroupByPart),
        ("SELECT o_custkey FROM orders ORDER BY nothing", E.InvalidOrderByPart),
        ("SELECT o_custkey, COUNT(*) n FROM orders GROUP BY o_custkey ORDER BY o_orderkey", E.InvalidOrderByPart),
        ("SELECT o_custkey FROM orders WINDOW BY nothing INTERVAL = 2", E.InvalidWindowByPart),
        ("SELECT l_orderkey, COUNT(*) n FROM lineitem WINDOW BY l_orderkey INTERVAL = 2", E.InvalidSQLStatement),
        ("PROCESS orders WITHIN no.such.Thing", E.MissingWithinClause),
    ],
)
def test_resolver_errors(spark, sf, text, error):
    with pytest.raises(error):
        testdata.session(spark, sf).execute(text)


def test_strict_literals(spark, sf):
    s = Session(spark, testdata.catalog(sf), strict=True)
    with pytest.raises(E.InvalidConditionValue):
        s.execute("SELECT o_orderkey FROM orders WHERE o_totalprice > 5")
    with pytest.raises(E.InvalidConditionValue):
        s.execute("SELECT o_orderkey FROM orders WHERE o_orderkey > 5.0")
    assert s.execute("SELECT o_orderkey FROM orders WHERE o_totalprice > 5.0").count() == 1500
    with pytest.raises(E.InvalidCondition):
        s.execute("SELECT o_orderkey FROM orders WHERE o_orderstatus > 'A'")


def test_random_predicates(spark, sf):
    rng = random.Random(7)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW orders AS SELECT * FROM '{sf}/orders.parquet'")
    s = testdata.session(spark, sf)

    def leaf():
        return rng.choice(
            [
                lambda: (f"o_orderkey {(o := rng.choice(['=', '<>', '<', '>', '<=', '>=']))} {(v := rng.randrange(1500))}", f"o_orderkey {o} {v}"),
                lambda: (f"o_totalprice > {(v := rng.randrange(400000))}.5", f"o_totalprice > {v}.5"),
                lambda: (f"o_orderstatus {(o := rng.choice(['=', '<>']))} '{(v := rng.choice('FOP'))}'", f"o_orderstatus {o} '{v}'"),
                lambda: (f"o_custkey {(n := rng.choice(['', 'NOT ']))}IN [{(v := ','.join(str(rng.randrange(150)) for _ in range(20)))}]", f"o_custkey {n}IN ({v})"),
                lambda: (f"o_orderpriority {(n := rng.choice(['', 'NOT ']))}LIKE '{(v := rng.choice(['URG', 'O', '-', '5']))}'", f"{n}contains(o_orderpriority, '{v}')"),
                lambda: ("o_orderkey > o_custkey", "o_orderkey > o_custkey"),
            ]
        )()

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return leaf()
        parts = [tree(depth - 1) for _ in range(rng.randrange(2, 4))]
        word = rng.choice([" AND ", " OR "])
        return tuple(word.join(f"({p[k]})" for p in parts) for k in (0, 1))

    for _ in range(25):
        mine, theirs = tree(3)
        got = sorted(r[0] for r in s.execute(f"SELECT o_orderkey FROM orders WHERE {mine}").collect())
        assert got == sorted(r[0] for r in duck.execute(f"SELECT o_orderkey FROM orders WHERE {theirs}").fetchall()), mine


# -- order of arrival

RUNS = ("seq long, k string, v int", "seq", (), [(i + 1, k, i + 1) for i, k in enumerate("AABAAAC")])


def test_short_windows(make):
    s = make(t=("seq long, v int", "seq", (), [(1, 10), (2, 20), (3, 30)]))
    window = lambda n: [tuple(r) for r in s.execute(f"SELECT seq, SUM(v) s, LAST(v) l FROM t WINDOW BY v INTERVAL = {n}").collect()]
    assert window(5) == [] and window(3) == [(1, 60, 30)] and sorted(window(1)) == [(1, 10, 10), (2, 20, 20), (3, 30, 30)]


def test_runs(make):
    s = make(t=RUNS)
    assert values(s.replay("SELECT STREAM k, COUNT(*) n, SUM(v) s FROM t GROUP BY k")) == [("A", 2, 3), ("A", 3, 15), ("B", 1, 3)]


def test_blocks_of_any_size_give_the_same(spark, make):
    from millrace.operators import arrival
    from pyspark.sql import functions as F

    rng = random.Random(1)
    rows = [(i * 3, rng.choice(["a", "b", None]), rng.randrange(9)) for i in range(300)]
    s = make(t=("seq long, k string, v int", "seq", (), rows))
    df = s.table("t")
    want = [(rows[i][0], sum(r[2] for r in rows[i : i + 7])) for i in range(294)]
    for size in (7, 10, 64, 10_000):
        got = arrival.row_windows(df, ["seq"], 7, lambda w: [F.first("seq").over(w).alias("seq"), F.sum("v").over(w).alias("s")], size)
        assert values(got) == sorted(want, key=repr)
        numbered = arrival.runs(df, ["seq"], ["k"], size)
        runs = [r[0] for r in numbered.orderBy("seq").select(arrival.RUN).collect()]
        expect, run = [], 0
        for i, r in enumerate(rows):
            run += i == 0 or r[1] != rows[i - 1][1]
            expect.append(run)
        assert runs == expect


@pytest.mark.parametrize("cuts", [[60], [7, 30, 60], [1, 2, 20, 21, 40, 55, 60]])
def test_streams_match_batches_however_rows_arrive(spark, sf, tmp_path, cuts):
    import os

    rows = sorted(spark.read.parquet(f"{sf}/events.parquet").collect(), key=lambda r: r.event_id)[:60]
    schema = testdata.catalog(sf)["events"].schema
    folder, whole, start = tmp_path / "log", tmp_path / "whole", 0
    folder.mkdir()
    for k, cut in enumerate(cuts):
        part = tmp_path / f"part{k}"
        spark.createDataFrame(rows[start:cut], schema).coalesce(1).write.parquet(str(part))
        file = next(part.glob("part-*.parquet"))
        target = folder / f"{k}.parquet"
        file.rename(target)
        os.utime(target, (1_700_000_000 + k, 1_700_000_000 + k))
        start = cut
    spark.createDataFrame(rows, schema).write.parquet(str(whole))
    s = Session(spark, Catalog([Entity("events", schema, id="event_id", path=str(whole))]))
    for statement, n in ((testdata.STREAM_WINDOW, 51), (testdata.STREAM_RUN, 49), (testdata.STREAM_FILTER, None)):
        live = s.execute(statement).start(path=f"{folder}/*", once=True).results()
        batch = s.replay(statement)
        assert live.columns == batch.columns and live.dtypes == batch.dtypes
        assert values(live) == values(batch)
        assert n is None or live.count() == n


def test_stream_goes_on_after_a_restart(spark, sf, tmp_path):
    rows = sorted(spark.read.parquet(f"{sf}/events.parquet").collect(), key=lambda r: r.event_id)[:30]
    schema = testdata.catalog(sf)["events"].schema
    log, checkpoint, out = str(tmp_path / "log"), str(tmp_path / "checkpoint"), str(tmp_path / "out")
    s = Session(spark, Catalog([Entity("events", schema, id="event_id", path=log)]))
    for a, b in ((0, 12), (12, 30)):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(log)
        s.execute("SELECT STREAM event_id, COUNT(*) n FROM events WINDOW BY event_id INTERVAL = 4").start(once=True, sink="parquet", output=out, checkpoint=checkpoint).stop()
    assert values(spark.read.parquet(out)) == sorted([(r.event_id, 4) for r in rows[:27]], key=repr)


def test_stream_joined_to_a_table(spark, sf):
    s = testdata.session(spark, sf)
    text = "SELECT STREAM event_id, c_name FROM events, customer WHERE user_id = c_custkey AND event_type = 'purchase'"
    live = s.execute(text).start(once=True)
    assert values(live.results()) == values(s.replay(text)) and live.results().count() > 0 and live.progress


def test_inline_view_and_own_aggregate(spark, sf):
    from pyspark.sql import functions as F

    s = testdata.session(spark, sf)
    s.register_aggregate("spread", lambda c: F.max(c) - F.min(c))
    got = s.execute("SELECT n_name, v.n FROM nation, (SELECT c_nationkey k, COUNT(*) n FROM customer GROUP BY c_nationkey) v WHERE n_nationkey = v.k AND v.n > 5")
    duck = duckdb.sql(f"SELECT n_name, n FROM '{sf}/nation.parquet', (SELECT c_nationkey k, count(*) n FROM '{sf}/customer.parquet' GROUP BY 1) WHERE n_nationkey = k AND n > 5")
    assert values(got) == sorted(duck.fetchall(), key=repr)
    got = s.execute("SELECT o_orderstatus, SPREAD(o_custkey) d, COUNT(*) n FROM orders GROUP BY o_orderstatus")
    duck = duckdb.sql(f"SELECT o_orderstatus, max(o_custkey) - min(o_custkey), count(*) FROM '{sf}/orders.parquet' GROUP BY 1")
    assert values(got) == sorted(duck.fetchall(), key=repr)
    with pytest.raises(ValueError):
        s.register_aggregate("sum", F.sum)
    with pytest.raises(E.InvalidTableDescription):
        s.execute("SELECT a FROM (COMMIT) v")


def test_streams_have_no_order(spark, sf):
    with pytest.raises(E.InvalidSQLStatement):
        testdata.session(spark, sf).execute("SELECT STREAM event_id FROM events ORDER BY event_id")


# -- transactions

TX = StructType([StructField("id", LongType()), StructField("v", IntegerType())])


@pytest.fixture
def store(spark, tmp_path):
    catalog = Catalog([Entity("tx", TX, id="id"), Entity("other", TX, id="id"), Entity("made", TX, id="id", generated=True, distributed=True), Entity("log", TX, id="id", append_only=True)])
    path = str(tmp_path / f"store-{uuid.uuid4().hex}")

    def open_(**options):
        return Session(spark, catalog, path, **options)

    s = open_()
    s.persist("tx", [{"id": i, "v": i} for i in (1, 2, 3)])
    s.commit()
    return open_


def test_read_your_writes_and_no_dirty_reads(store):
    a, b = store(), store()
    a.persist("tx", [{"id": 2, "v": 19}, {"id": 4, "v": 4}, {"id": 2, "v": 20}])
    a.delete("tx", [1])
    assert values(a.table("tx")) == [(2, 20), (3, 3), (4, 4)]
    assert values(b.table("tx")) == [(1, 1), (2, 2), (3, 3)]
    a.execute("COMMIT")
    assert values(b.table("tx")) == [(2, 20), (3, 3), (4, 4)]
    assert b.find("tx", 2).v == 20 and b.find("tx", 1) is None
    assert sorted(r.id for r in b.content("tx")) == [2, 3, 4]


def test_rollback_and_leftovers(store):
    a = store()
    a.persist("tx", [{"id": 2, "v": 20}])
    a.execute("ROLLBACK")
    assert values(a.table("tx")) == [(1, 1), (2, 2), (3, 3)]
    a.persist("tx", [{"id": 9, "v": 9}])  # a session that breaks off before its commit
    b = store()
    assert values(b.table("tx")) == [(1, 1), (2, 2), (3, 3)]
    assert b.store.vacuum() >= 1 and values(b.table("tx")) == [(1, 1), (2, 2), (3, 3)]


def test_conflicts_and_other_tables(store):
    a, b, c = store(), store(), store()
    a.persist("tx", [{"id": 1, "v": 10}])
    b.persist("tx", [{"id": 1, "v": 11}])
    c.persist("other", [{"id": 1, "v": 5}])
    a.commit()
    c.commit()
    with pytest.raises(E.CommitConflict):
        b.commit()
    assert values(store().table("tx"))[0] == (1, 10) and values(store().table("other")) == [(1, 5)]


def test_several_tables_commit_at_once(store):
    a = store()
    a.persist("tx", [{"id": 7, "v": 7}])
    a.persist("other", [{"id": 7, "v": 7}])
    assert store().table("other").count() == 0
    a.commit()
    assert store().table("other").count() == 1 and store().table("tx").count() == 4


def test_serializable_sees_one_snapshot(store):
    a, b = store(isolation="serializable"), store()
    assert a.table("tx").count() == 3
    b.delete("tx", [1])
    b.commit()
    assert a.table("tx").count() == 3 and store().table("tx").count() == 2
    a.commit()
    assert a.table("tx").count() == 2


def test_generated_ids(store):
    a = store(node=5)
    a.persist("made", [a.new_entity("made", v=1), a.new_entity("made", v=2)])
    a.commit()
    b = store(node=6)
    b.persist("made", [{"v": 3}])
    b.commit()
    ids = sorted(r[0] for r in values(b.table("made")))
    assert ids == [1 * 64 + 5, 2 * 64 + 5, 3 * 64 + 6]
    many = b.with_ids("made", b.table("tx").select("v"))
    assert many.select("id").distinct().count() == 3


def test_append_only_and_duplicates(store):
    a = store()
    a.persist("log", [{"id": 1, "v": 1}])
    a.persist("log", [{"id": 1, "v": 2}])
    assert a.table("log").count() == 2 and values(a.duplicates("log")) == [(1, 2)]
    with pytest.raises(E.CannotAccessToDeletedRecord):
        a.delete_one("tx", 99)
    with pytest.raises(E.InvalidColumnDescription):
        a.new_entity("tx", w=1)


@pytest.fixture
def processors():
    """Local classes travel to executors by value."""

    class Odd:
        def process(self, row):
            if row["v"] == 5:
                raise RuntimeError("not this one")
            return row["v"] % 2 == 1

        def delete(self):
            return True

    class Keep(Odd):
        def delete(self):
            return False

    return Odd, Keep


def test_process(store, processors):
    a = store()
    a.persist("tx", [{"id": i, "v": None if i == 8 else i} for i in range(1, 11)])
    a.commit()
    a.register_processor("Odd", processors[0])
    a.register_processor("Keep", processors[1])
    assert values(a.execute("PROCESS tx WITHIN Keep")) == sorted([(i, None if i == 8 else i) for i in range(1, 11)], key=repr)
    a.rollback()
    left = a.execute("PROCESS tx WITHIN Odd WHERE v > 2")
    assert sorted(r[0] for r in values(left)) == [1, 2, 4, 5, 6, 8, 10]
    assert store().table("tx").count() == 10
    a.execute("COMMIT")
    assert store().table("tx").count() == 7
    assert a.store.lock("tx")
    with pytest.raises(E.UnableToLockTableForProcess):
        a.execute("PROCESS tx WITHIN Odd")
    a.store.unlock("tx")


def test_process_stream(spark, store, processors, tmp_path):
    a = store()
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    spark.createDataFrame([(i, i) for i in range(10)], TX).coalesce(1).write.parquet(log)
    a.register_processor("Odd", processors[0])
    from millrace.plans.parser import parse

    a.process_stream(parse("PROCESS STREAM tx WITHIN Odd WHERE v > 2"), path=log, output=out, once=True)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [4, 5, 6, 8]


def test_entities_are_checked():
    with pytest.raises(E.InvalidTableDescription):
        Entity("t", TX, id="nothing")
    with pytest.raises(E.InvalidTableDescription):
        Entity("t", TX, indexes=(Index(("x",)),))
    with pytest.raises(E.InvalidTableDescription):
        Catalog([Entity("t", TX), Entity("t", TX)])


def test_all_types_survive_storage(spark, tmp_path):
    schema = StructType.fromDDL("id long, i int, l long, f float, d double, s string, t timestamp_ntz, b binary, y byte, a array<string>")
    s = Session(spark, Catalog([Entity("types", schema, id="id")]), str(tmp_path / "types"))
    row = {"id": 1, "i": 2, "l": 3, "f": 0.5, "d": 0.25, "s": "é", "t": datetime.datetime(2020, 1, 2, 3), "b": bytearray(b"\0x"), "y": 7, "a": ["p", None]}
    s.persist("types", [row, {"id": 2}])
    s.commit()
    assert s.find("types", 1).asDict() == row
    assert set(s.find("types", 2).asDict().values()) == {2, None}
    s.register_processor("Odd", type("P", (), {"process": lambda self, r: False, "delete": lambda self: True}))
    assert s.execute("PROCESS types WITHIN Odd").schema == schema


def test_streams_keep_nulls_and_types(spark, tmp_path):
    """Live windows and runs give what replay gives, for nulls in every column and integers beyond 2 ** 53."""
    import datetime as dt

    schema = StructType.fromDDL("seq long, k string, i int, l long, d double, t timestamp_ntz, b boolean, day date")
    big, day = 2**53 + 1, dt.date(2024, 1, 1)
    rows = []
    for s in range(60):
        when = dt.datetime(2024, 1, 1, 0, 0, s % 7, s)
        row = [s, "ab"[s // 3 % 2], s % 5, big + s, s / 3, when, s % 2 == 0, day + dt.timedelta(s % 4)]
        rows.append(tuple(None if c and (s * 7 + c) % 4 == 0 else v for c, v in enumerate(row)))
    s = Session(spark, Catalog([Entity("t", schema, id="seq")]), str(tmp_path / "store"))
    s.persist("t", spark.createDataFrame(rows, schema))
    s.commit()
    for text in (
        "SELECT STREAM seq, t, k, b, day, SUM(l) s, AVG(l) m, COUNT(d) n, MIN(t) a, MAX(day) z, LAST(i) i, MIN(k) w, SUM(d) e FROM t WINDOW BY seq INTERVAL = 4",
        "SELECT STREAM k, SUM(l) s, AVG(i) m, COUNT(d) n, MIN(t) a, MAX(day) z, LAST(l) i, MAX(b) w, AVG(d) e FROM t GROUP BY k",
    ):
        live, replay = s.execute(text).start(once=True).results(), s.replay(text)
        assert live.dtypes == replay.dtypes
        for a, b in zip(sorted(map(tuple, live.collect()), key=repr), sorted(map(tuple, replay.collect()), key=repr), strict=True):
            assert a[:-1] == b[:-1] and (a[-1] is None and b[-1] is None or a[-1] == pytest.approx(b[-1]))


def test_spans_match_brute_force():
    from millrace.streaming.stateful import sliding

    rng = random.Random(3)
    for _ in range(200):
        values = [rng.choice([None, rng.randrange(-9, 9)]) for _ in range(rng.randrange(1, 30))]
        n = rng.randrange(1, 7)
        for f in ("COUNT", "SUM", "AVG", "MIN", "MAX", "LAST", None):
            want = []
            for i in range(len(values) - n + 1):
                w = values[i : i + n]
                known = [v for v in w if v is not None]
                want.append({None: w[0], "LAST": w[-1], "COUNT": len(known), "SUM": sum(known) if known else None, "MIN": min(known, default=None), "MAX": max(known, default=None), "AVG": int(sum(known) / len(known)) if known else None}[f])
            assert sliding(f, values, n, True) == want


def test_windows_freeze_only_what_they_need(spark, sf, monkeypatch):
    from millrace.operators import arrival

    seen = []
    monkeypatch.setattr(arrival, "kept", lambda df, name: seen.append(df.columns) or df)
    s = testdata.session(spark, sf)
    s.execute("SELECT event_id, AVG(user_id) m FROM events WINDOW BY event_id INTERVAL = 10")
    s.replay("SELECT STREAM event_type, COUNT(event_id) n FROM events GROUP BY event_type")
    assert [sorted(c.split("\x1f")[-1] for c in cs) for cs in seen] == [["_range", "event_id", "user_id"], ["_range", "event_id", "event_type"]]


def test_process_rewrites_only_files_with_removed_rows(spark, store, processors):
    a = store()
    a.persist("log", spark.createDataFrame([(i, 2 * i + (i == 7)) for i in range(20)], TX).repartitionByRange(4, "id"))
    a.commit()
    before = {f for e in a.entries(a.catalog["log"]) for f in a.store.parts(e)}
    a.register_processor("Odd", processors[0])
    assert a.execute("PROCESS log WITHIN Odd").count() == 19
    after = set(a.entries(a.catalog["log"]))
    assert len(before & after) == len(before) - 1


def test_a_stream_sees_each_committed_row_once(spark, store, processors, tmp_path):
    a, b = store(), store()
    follow = lambda: store().execute("SELECT STREAM id, v FROM tx").start(once=True, output=str(tmp_path / "rows"), checkpoint=str(tmp_path / "at")).results()
    b.persist("tx", [{"id": 9, "v": 99}])
    assert values(follow()) == [(1, 1), (2, 2), (3, 3)]
    b.rollback()
    a.persist("tx", [{"id": 2, "v": 20}, {"id": 4, "v": 4}])
    a.persist("tx", [{"id": 4, "v": 40}, {"id": 5, "v": 5}])
    a.delete("tx", [5])
    a.persist("other", [{"id": 7, "v": 7}])
    a.commit()
    assert values(follow()) == sorted([(1, 1), (2, 2), (3, 3), (2, 20), (4, 40)], key=repr)
    a.register_processor("Odd", processors[0])
    a.execute("PROCESS tx WITHIN Odd")  # what it leaves isn't new
    a.commit()
    assert len(values(follow())) == 5
    fresh = store().execute("SELECT STREAM id, v FROM tx").start(once=True).results()
    assert values(fresh) == values(a.table("tx")) == sorted([(2, 20), (4, 40)], key=repr)


def test_rows_of_a_frame_with_equal_ids(spark, store):
    a = store()
    a.persist("tx", spark.createDataFrame([(1, 5), (1, 9), (1, None), (8, None), (8, None)], TX))
    assert values(a.table("tx")) == sorted([(1, 9), (2, 2), (3, 3), (8, None)], key=repr)


def test_an_old_lock_can_be_taken_over(store):
    a = store().store
    assert a.lock("tx") and not a.lock("tx")
    assert a.lock("tx", seconds=0)


def test_ties_in_the_sequence_have_one_result(spark, make):
    rows = [(i // 3, "ab"[i % 2], i) for i in range(30)]
    seen = []
    for order in (rows, rows[::-1]):
        s = make(t=("seq long, k string, v int", None, ("seq",), order))
        seen.append(values(s.execute("SELECT seq, k, SUM(v) s FROM t WINDOW BY seq INTERVAL = 4")) + values(s.replay("SELECT STREAM k, LAST(v) v FROM t GROUP BY k")))
    assert seen[0] == seen[1]


def test_an_or_of_equalities_joins_by_keys(make):
    rows = [(1, 1, 2), (2, None, 3), (3, 3, 3), (4, None, None), (5, 9, 1), (6, 2, None)]
    s = make(a=("id long, x int, y int", "id", (), rows), b=("k int, v string", None, (), [(1, "p"), (2, "q"), (3, "r"), (3, "s"), (None, "t")]))
    df = s.execute("SELECT id, v FROM a, b WHERE x = k OR y = k")
    assert values(df) == sorted([(1, "p"), (1, "q"), (2, "r"), (2, "s"), (3, "r"), (3, "s"), (5, "p"), (6, "q")], key=repr)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 2 and "(x" in plan and df._jdf.queryExecution().executedPlan().toString().count("NestedLoop") == 0


def test_a_join_on_frequent_keys_is_made_in_pieces(spark, tmp_path, monkeypatch):
    """Few keys with many rows on both sides don't land in a few tasks; keys of nulls and of one side give nothing."""
    from millrace.plans import lower

    monkeypatch.setattr(lower, "JOIN_ROWS", 100, raising=False)
    a = [(i, i % 3 if i % 11 else None, i % 2) for i in range(600)] + [(1000, 7, 1)]
    b = [(i, i % 3 if i % 13 else None, i % 2) for i in range(90)] + [(1000, 8, 1)]
    entities = []
    for name, ddl, key, rows in (("a", "i long, k int, v int", "i", a), ("b", "j long, k int, v int", "j", b), ("c", "k int, w int", None, [(k % 3, k) for k in range(40)])):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(tmp_path / name))
        entities.append(Entity(name, StructType.fromDDL(ddl), id=key, path=str(tmp_path / name)))
    s = Session(spark, Catalog(entities))
    for text, want in (
        ("SELECT i, j FROM a, b WHERE a.k = b.k", [(x[0], y[0]) for x in a for y in b if x[1] is not None and x[1] == y[1]]),
        ("SELECT i, j FROM a, b WHERE a.k = b.k AND a.v = b.v AND i > j", [(x[0], y[0]) for x in a for y in b if x[1] is not None and x[1:] == y[1:] and x[0] > y[0]]),
        ("SELECT j, w FROM b, c WHERE b.k = c.k", [(y[0], k) for y in b for k in range(40) if y[1] == k % 3]),
        ("SELECT j, w, i FROM b, c, a WHERE b.k = c.k AND j = i", [(y[0], k, y[0]) for y in b for k in range(40) if y[1] == k % 3]),
    ):
        got = s.execute(text)
        most = max(got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())
        assert values(got) == sorted(want, key=repr)
        assert most < len(want) / 4


def log_of(spark, folder, schema, batches):
    """A session over a table of one file a batch, each a micro-batch of its stream."""
    import os

    folder.mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"of{k}"))
        (file,) = (folder / f"of{k}").glob("part-*.parquet")
        os.utime(file.rename(folder / f"{k}.parquet"), (1_700_000_000 + k, 1_700_000_000 + k))
    return Session(spark, Catalog([Entity("t", StructType.fromDDL(schema), id="i", path=f"{folder}/*.parquet")]))


RUNS = "SELECT STREAM k, COUNT(*) n, COUNT(v) c, SUM(v) s, AVG(v) m, MIN(v) a, MAX(v) z, LAST(v) l FROM t WHERE i > 0 GROUP BY k"


@pytest.mark.parametrize("block", [1 << 16, 1])
def test_stream_runs_over_many_batches_keep_no_batch_in_a_task(spark, tmp_path, monkeypatch, block):
    """A run may go on through whole batches, nulls are a key, a batch may be empty; no operator keeps rows as its state."""
    keys = [["a", "a"], ["a"], ["a", None], [None, "b", "b"], ["b"], ["c", "a"]]
    rows = iter(range(1, 99))
    batches = [[(i, k, i * 3 if i % 4 else None) for k, i in zip(ks, rows)] for ks in keys]
    s = log_of(spark, tmp_path / "log", "i long, k string, v int", [*batches[:2], [(-1, "z", 1)], *batches[2:]])
    monkeypatch.setattr("millrace.operators.arrival.BLOCK", block, raising=False)
    live = s.execute(RUNS).start(once=True)
    got = [tuple(r) for r in live.results().collect()]
    assert sorted(got, key=repr) == values(s.replay(RUNS))
    assert sorted((r[:3] for r in got), key=repr) == sorted([("a", 4, 3), (None, 2, 2), ("b", 3, 2), ("c", 1, 1)], key=repr)
    assert len(live.progress) == 7 and not any(p["stateOperators"] for p in live.progress)


def test_stream_windows_longer_than_a_batch(spark, tmp_path, monkeypatch):
    """Rows that several batches have left, later rows of lesser sequence, and a first batch in many ranges."""
    sizes, rows = (20, 2, 1, 3), iter([*range(20), *range(30, 32), 5, 40, 41, 42])
    batches = [[(next(rows), "abc"[j % 3], j or None) for j in range(n)] for n in sizes]
    s = log_of(spark, tmp_path / "log", "i long, k string, v int", batches)
    monkeypatch.setattr("millrace.operators.arrival.BLOCK", 7, raising=False)
    live = s.execute("SELECT STREAM i, COUNT(v) n, SUM(v) s, LAST(k) l FROM t WINDOW BY i INTERVAL = 6").start(once=True)
    flat = [r for b in batches for r in b]
    spans = [flat[a : a + 6] for a in range(len(flat) - 5)]
    assert values(live.results()) == sorted([(w[0][0], sum(r[2] is not None for r in w), sum(r[2] or 0 for r in w), w[-1][1]) for w in spans], key=repr)
    assert not any(p["stateOperators"] for p in live.progress)


def test_a_repeated_batch_gives_its_windows_once(spark, tmp_path):
    """A batch whose end was not recorded is made anew after a restart, from what the one before it left."""
    log, at, out = tmp_path / "log", tmp_path / "at", tmp_path / "out"
    s = log_of(spark, log, "i long, k string, v int", [[(i, "a", i) for i in range(5)], [(i, "b", i) for i in range(5, 9)]])
    start = lambda: s.execute("SELECT STREAM i, SUM(v) s FROM t WINDOW BY i INTERVAL = 3").start(once=True, output=str(out), checkpoint=str(at)).results()
    want = [(i, 3 * i + 3) for i in range(7)]
    assert values(start()) == want
    (at / "commits" / "1").unlink()
    (at / "commits" / ".1.crc").unlink(missing_ok=True)
    left = sorted(p.name for p in (at / "left").iterdir() if not p.name.startswith("."))
    assert values(start()) == want and left == ["0", "1"]


def test_process_moves_no_rows_to_find_the_removed_ones(spark, store, monkeypatch):
    from millrace.sources.store import Store

    class Edges:
        """A processor that removes rows around the edges of bytes and blocks of row numbers."""

        def process(self, row: dict) -> bool:
            return row["id"] % 32768 in (0, 7, 8, 9, 32767) or row["id"] > 69990

        def delete(self) -> bool:
            return True

    a, plans, write = store(), [], Store.write
    monkeypatch.setattr(Store, "write", lambda self, table, df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(self, table, df))
    a.persist("log", spark.range(70000).selectExpr("id", "int(id * 2) v").coalesce(1))
    a.commit()
    a.register_processor("Edges", Edges)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = a.execute("PROCESS log WITHIN Edges WHERE id <> 8")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    one = Edges()
    assert [r[0] for r in left.orderBy("id").collect()] == [i for i in range(70000) if i == 8 or not one.process({"id": i})]
    assert len(plans) == 2 and "SortMergeJoin" not in plans[1]
