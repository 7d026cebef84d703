"""The test tables as entities, and statements over them with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import errors as E
from .catalog import Catalog, Entity, Index
from .plans.parser import parse
from .session import Session, consume
from .sources.shared import shared_dir

SCHEMAS = {
    "region": ("r_regionkey int, r_name string", "r_regionkey", ()),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", "n_nationkey", ("n_regionkey",)),
    "customer": ("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", "c_custkey", ("c_nationkey",)),
    "supplier": ("s_suppkey long, s_name string, s_nationkey int, s_acctbal double", "s_suppkey", ("s_nationkey",)),
    "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", "p_partkey", ()),
    "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string", "o_orderkey", ("o_custkey",)),
    "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz", None, ("l_orderkey", "l_partkey", "l_suppkey")),
    "events": ("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", "event_id", ()),
}


def catalog(sf_dir: str) -> Catalog:
    out = Catalog()
    for name, (ddl, key, others) in SCHEMAS.items():
        indexes = ([Index((key,), True)] if key else []) + [Index((c,)) for c in others]
        out.register(Entity(name, StructType.fromDDL(ddl), id=key, indexes=tuple(indexes), path=f"{sf_dir}/{name}.parquet"))
    return out


def session(spark: SparkSession, sf_dir: str) -> Session:
    return Session(spark, catalog(sf_dir))


#: name: (statement, SQL for the same rows)
STATEMENTS: dict[str, tuple[str, str]] = {
    "select_star": ("SELECT * FROM nation", "SELECT * FROM nation"),
    "project_alias": ("SELECT c_custkey k, c.c_name FROM customer c", "SELECT c_custkey AS k, c_name AS \"cc_name\" FROM customer"),
    "filter_and_nested_or": (
        "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND (o_totalprice > 400000.0 OR o_orderpriority = '1-URGENT') AND o_custkey < 1000",
        "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND (o_totalprice > 400000.0 OR o_orderpriority = '1-URGENT') AND o_custkey < 1000",
    ),
    "filter_xor": ("SELECT n_name FROM nation WHERE n_regionkey = 1 XOR n_nationkey < 10", "SELECT n_name FROM nation WHERE (n_regionkey = 1) <> (n_nationkey < 10)"),
    "literal_on_left": ("SELECT n_name FROM nation WHERE 5 < n_nationkey AND 20 >= n_nationkey", "SELECT n_name FROM nation WHERE 5 < n_nationkey AND 20 >= n_nationkey"),
    "not_equal": ("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O'", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O'"),
    "like_contains": ("SELECT p_partkey, p_name FROM part WHERE p_name like 'a'", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'a')"),
    "not_like": ("SELECT p_partkey, p_name FROM part WHERE p_name NOT LIKE 'a'", "SELECT p_partkey, p_name FROM part WHERE NOT contains(p_name, 'a')"),
    "in_list": ("SELECT n_name FROM nation WHERE n_regionkey IN [1,3]", "SELECT n_name FROM nation WHERE n_regionkey IN (1, 3)"),
    "not_in_list": ("SELECT n_name FROM nation WHERE n_regionkey NOT IN [1,3]", "SELECT n_name FROM nation WHERE n_regionkey NOT IN (1, 3)"),
    "in_strings": ("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ['1-URGENT','2-HIGH']", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "in_select": ("SELECT c_custkey FROM customer WHERE c_nationkey IN [SELECT n_nationkey FROM nation WHERE n_regionkey = 2]", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)"),
    "not_in_select": ("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN [SELECT n_nationkey FROM nation WHERE n_regionkey = 2]", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)"),
    "inline_view": (
        "SELECT n_name, v.n customers FROM nation, (SELECT c_nationkey k, COUNT(*) n FROM customer GROUP BY c_nationkey) v WHERE n_nationkey = v.k",
        "SELECT n_name, n AS customers FROM nation, (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) WHERE n_nationkey = k",
    ),
    "date_eq": ("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate = '03.10.1998'", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate = TIMESTAMP '1998-10-03'"),
    "date_in": ("SELECT o_orderkey FROM orders WHERE o_orderdate IN ['03.10.1998', '01.02.1997']", "SELECT o_orderkey FROM orders WHERE o_orderdate IN (TIMESTAMP '1998-10-03', TIMESTAMP '1997-02-01')"),
    "date_range": ("SELECT o_orderkey FROM orders WHERE o_orderdate >= '01.01.1997' AND o_orderdate < '01.02.1997'", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-02-01'"),
    "is_null": (
        "SELECT v.k, v.day FROM (SELECT o_orderkey k, o_orderpriority p, TO_DATE(o_orderpriority) day, TO_NUMBER(o_orderstatus) n FROM orders) v WHERE v.n IS NULL AND v.day IS NULL AND v.k < 1000",
        "SELECT o_orderkey AS vk, NULL::TIMESTAMP AS vday FROM orders WHERE try_cast(o_orderstatus AS DOUBLE) IS NULL AND o_orderkey < 1000",
    ),
    "is_not_null": ("SELECT o_orderkey FROM orders WHERE o_orderpriority IS NOT NULL", "SELECT o_orderkey FROM orders WHERE o_orderpriority IS NOT NULL"),
    "column_compare": ("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey > l_suppkey", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey > l_suppkey"),
    "find_by_id": ("SELECT * FROM orders WHERE o_orderkey = 7", "SELECT * FROM orders WHERE o_orderkey = 7"),
    "distinct": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    "join_unique_key": ("SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey", "SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey"),
    "join_filtered": ("SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey AND c_acctbal > 5000.0 AND o_orderstatus = 'F'", "SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey AND c_acctbal > 5000.0 AND o_orderstatus = 'F'"),
    "join_nonunique": ("SELECT c_custkey, s_suppkey FROM customer, supplier WHERE c_nationkey = s_nationkey", "SELECT c_custkey, s_suppkey FROM customer, supplier WHERE c_nationkey = s_nationkey"),
    "join_or_across": ("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey OR n_nationkey = r_regionkey", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey OR n_nationkey = r_regionkey"),
    "theta_join": ("SELECT n_name, r_name FROM nation, region WHERE n_regionkey > r_regionkey", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey > r_regionkey"),
    "cross_join": ("SELECT n_name, r_name FROM nation, region", "SELECT n_name, r_name FROM nation, region"),
    "self_join": ("SELECT a.n_name one, b.n_name two FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey", "SELECT a.n_name AS one, b.n_name AS two FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey"),
    "four_way": (
        "SELECT n_name, COUNT(l_linenumber) cnt FROM lineitem, nation, orders, customer WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey GROUP BY n_name",
        "SELECT n_name, count(l_linenumber) AS cnt FROM lineitem, orders, customer, nation WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey GROUP BY n_name",
    ),
    "group_int": (
        "SELECT l_returnflag, SUM(l_linenumber) total, AVG(l_linenumber) mean, MIN(l_linenumber) low, MAX(l_linenumber) high FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, sum(l_linenumber)::BIGINT AS total, (sum(l_linenumber) // count(l_linenumber))::BIGINT AS mean, min(l_linenumber) AS low, max(l_linenumber) AS high FROM lineitem GROUP BY l_returnflag",
    ),
    "group_two_columns": ("SELECT l_returnflag, l_linestatus, COUNT(*) n FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL"),
    "group_min_max_text": ("SELECT p_brand, MIN(p_name) low, MAX(p_name) high FROM part GROUP BY p_brand", "SELECT p_brand, min(p_name) AS low, max(p_name) AS high FROM part GROUP BY p_brand"),
    "global_agg": ("SELECT COUNT(o_orderkey) n, SUM(o_custkey) total, MAX(o_orderdate) latest FROM orders", "SELECT count(o_orderkey) AS n, sum(o_custkey)::BIGINT AS total, max(o_orderdate) AS latest FROM orders"),
    "count_star": ("SELECT COUNT(*) n FROM lineitem", "SELECT count(*) AS n FROM lineitem"),
    "last_by_order": ("SELECT event_type, LAST(value) latest FROM events GROUP BY event_type", "SELECT event_type, arg_max(value, event_id) AS latest FROM events GROUP BY event_type"),
    "having": ("SELECT o_custkey, COUNT(o_orderkey) n FROM orders GROUP BY o_custkey HAVING n > 12", "SELECT o_custkey, count(o_orderkey) AS n FROM orders GROUP BY o_custkey HAVING count(o_orderkey) > 12"),
    "having_other": ("SELECT o_custkey, COUNT(o_orderkey) n FROM orders GROUP BY o_custkey HAVING MAX(o_totalprice) < 250000.0", "SELECT o_custkey, count(o_orderkey) AS n FROM orders GROUP BY o_custkey HAVING max(o_totalprice) < 250000.0"),
    "group_order": ("SELECT o_orderpriority, COUNT(o_orderkey) n FROM orders GROUP BY o_orderpriority ORDER BY o_orderpriority", "SELECT o_orderpriority, count(o_orderkey) AS n FROM orders GROUP BY o_orderpriority ORDER BY o_orderpriority"),
    "order_by": ("SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderkey", "SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderkey"),
    "order_by_unselected": ("SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey"),
    "desc_limit": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "between": ("SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 10 AND 20 AND o_orderdate NOT BETWEEN '01.01.1995' AND '31.12.1996'", "SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 10 AND 20 AND o_orderdate NOT BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'"),
    "offset": ("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10 OFFSET 5", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10 OFFSET 5"),
    "nulls_first": ("SELECT n.n, n.t FROM (SELECT o_orderkey n, TO_NUMBER(o_orderstatus) t FROM orders WHERE o_orderkey < 40) n ORDER BY n.t NULLS FIRST, n.n DESC", "SELECT o_orderkey AS nn, NULL::DOUBLE AS nt FROM orders WHERE o_orderkey < 40 ORDER BY nt NULLS FIRST, nn DESC"),
    "union": ("SELECT c_nationkey k FROM customer WHERE c_custkey < 50 UNION SELECT s_nationkey FROM supplier", "SELECT c_nationkey AS k FROM customer WHERE c_custkey < 50 UNION SELECT s_nationkey FROM supplier"),
    "union_all": ("SELECT c_nationkey k FROM customer UNION ALL SELECT s_nationkey FROM supplier", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
    "intersect": ("SELECT c_nationkey k FROM customer WHERE c_custkey < 20 INTERSECT SELECT s_nationkey FROM supplier", "SELECT c_nationkey AS k FROM customer WHERE c_custkey < 20 INTERSECT SELECT s_nationkey FROM supplier"),
    "except": ("SELECT c_nationkey k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier"),
    "to_char": ("SELECT o_orderkey, TO_CHAR(o_custkey) customer FROM orders", "SELECT o_orderkey, o_custkey::VARCHAR AS customer FROM orders"),
    "to_number": ("SELECT v.k, TO_NUMBER(v.t) number FROM (SELECT o_orderkey k, TO_CHAR(o_totalprice) t FROM orders) v", "SELECT o_orderkey AS vk, o_totalprice AS number FROM orders"),
    "to_number_of_text": ("SELECT n_name, TO_NUMBER(n_name) number FROM nation", "SELECT n_name, try_cast(n_name AS DOUBLE) AS number FROM nation"),
    "count_window_10": (
        "SELECT event_id, COUNT(event_id) n, SUM(user_id) total, AVG(user_id) mean FROM events WINDOW BY event_id INTERVAL = 10",
        "SELECT event_id, n, total, mean FROM (SELECT first(event_id) OVER w AS event_id, count(event_id) OVER w AS n, (sum(user_id) OVER w)::BIGINT AS total, (sum(user_id) OVER w // count(user_id) OVER w)::BIGINT AS mean FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) WHERE n = 10",
    ),
    "count_window_5_all": (
        "SELECT event_type, MIN(value) low, MAX(value) high, LAST(value) latest, AVG(user_id) mean FROM events WHERE user_id > 10 WINDOW BY event_id INTERVAL = 5",
        "SELECT event_type, low, high, latest, mean FROM (SELECT first(event_type) OVER w AS event_type, min(value) OVER w AS low, max(value) OVER w AS high, last(value) OVER w AS latest, (sum(user_id) OVER w // count(user_id) OVER w)::BIGINT AS mean, count(*) OVER w AS n FROM events WHERE user_id > 10 WINDOW w AS (ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE n = 5",
    ),
}

RUN_SQL = """
WITH flagged AS (SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) OR row_number() OVER (ORDER BY event_id) = 1)::INT AS new FROM events WHERE {where}),
numbered AS (SELECT *, sum(new) OVER (ORDER BY event_id) AS run FROM flagged)
SELECT event_type, count(event_id) AS n, sum(user_id)::BIGINT AS total, arg_max(value, event_id) AS latest FROM numbered WHERE run < (SELECT max(run) FROM numbered) GROUP BY event_type, run
"""
STREAM_RUN = "SELECT STREAM event_type, COUNT(event_id) n, SUM(user_id) total, LAST(value) latest FROM events GROUP BY event_type"
STREAM_WINDOW = STATEMENTS["count_window_10"][0].replace("SELECT", "SELECT STREAM", 1)
STREAM_JOIN = "SELECT STREAM event_id, c_name, value FROM events, customer WHERE user_id = c_custkey AND value > 100.0"
STREAM_FILTER = "SELECT STREAM event_id, event_type, value FROM events WHERE event_type IN ['purchase','error'] AND value > 50.0"


class KeepsRich:
    """A processor that removes orders of even customers, and fails on some rows, which therefore stay."""

    def process(self, row: dict) -> bool:
        if row["o_orderkey"] % 10 == 3:
            raise ValueError("this one can't be processed")
        return row["o_custkey"] % 2 == 0

    def delete(self) -> bool:
        return True


def _process(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    return s.execute("PROCESS orders WITHIN millrace.testdata.KeepsRich WHERE o_orderstatus = 'F'")


def stored(spark: SparkSession, sf_dir: str, *names: str, **more) -> Session:
    """A session over a store of its own that holds these tables."""
    entities = [Entity(n, StructType.fromDDL(SCHEMAS[n][0]), id=SCHEMAS[n][1], **more) for n in names]
    s = Session(spark, Catalog(entities), f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    for n in names:
        s.persist(n, spark.read.parquet(f"{sf_dir}/{n}.parquet"))
    s.commit()
    return s


def other(s: Session, **options) -> Session:
    """Another session over the same store."""
    return Session(s.spark, s.catalog, s.store.folder.path, **options)


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(spark, sf_dir, "orders")
    changed = s.table("orders").where("o_orderkey % 100 = 0").withColumn("o_orderstatus", F.lit("X"))
    more = s.table("orders").where("o_orderkey % 100 = 1").withColumn("o_orderkey", F.col("o_orderkey") + 100_000_000)
    s.persist("orders", changed.unionByName(more))
    s.commit()
    return s.table("orders")


def _delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(spark, sf_dir, "orders")
    s.delete("orders", s.table("orders").where("o_orderkey % 7 = 0"))
    s.commit()
    return s.table("orders")


def _purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(spark, sf_dir, "nation")
    s.purge("nation", [3, 5, 99])
    s.commit()
    return s.table("nation")


def _rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(spark, sf_dir, "orders")
    s.delete("orders", s.table("orders").where("o_orderkey % 7 = 0"))
    s.execute("ROLLBACK")
    return s.table("orders")


def _stored_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(spark, sf_dir, "orders")
    s.execute("PROCESS orders WITHIN millrace.testdata.KeepsRich WHERE o_orderstatus = 'F'")
    s.execute("COMMIT")
    return s.table("orders")


def _new_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(spark, sf_dir, "nation")
    s.persist("nation", [s.new_entity("nation", n_nationkey=100, n_name="NEW"), s.new_entity("nation", n_nationkey=7)])
    s.commit()
    return s.table("nation")


def _generated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of three rows of one session, and distributed ids of two nodes."""
    schema = StructType.fromDDL("id long, name string")
    plain, spread = Entity("plain", schema, id="id", generated=True), Entity("spread", schema, id="id", generated=True, distributed=True)
    s = Session(spark, Catalog([plain, spread]), f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", node=3)
    s.persist("plain", [{"name": n} for n in "abc"])
    s.persist("spread", [{"name": "d"}])
    s.commit()
    t = other(s, node=5)
    t.persist("spread", [{"name": "e"}])
    t.commit()
    return s.table("plain").unionByName(s.table("spread"))


def _isolation(isolation: str) -> Callable[[SparkSession, str], DataFrame]:
    """What a session sees of another's changes: before its commit and, after a first look, after it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = stored(spark, sf_dir, "nation")
        t = other(s, isolation=isolation)
        s.delete("nation", [1, 2])
        before = t.table("nation").select(F.lit("before").alias("seen"), "n_nationkey")
        s.commit()
        return before.unionByName(t.table("nation").select(F.lit("after").alias("seen"), "n_nationkey"))

    return run


def _table_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error of a PROCESS while another session holds the table's lock, and the rows after it was released."""
    s = stored(spark, sf_dir, "orders")
    statement, errors = "PROCESS orders WITHIN millrace.testdata.KeepsRich", []
    with s.locked(s.catalog["orders"]):
        try:
            other(s).execute(statement)
        except E.UnableToLockTableForProcess as e:
            errors.append(type(e).__name__)
    left = other(s).execute(statement).agg(F.count(F.lit(1)).alias("n"))
    return left.select(F.lit(",".join(errors)).alias("error"), "n")


def _duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(spark, sf_dir, "nation", append_only=True)
    s.persist("nation", [{"n_nationkey": 4, "n_name": "AGAIN"}])
    s.commit()
    return s.duplicates("nation")


class Names:
    """Called for each deleted row."""

    def __init__(self):
        self.seen: list[str] = []

    def __call__(self, row: dict) -> None:
        self.seen.append(row["n_name"])


def _on_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    hook = Names()
    s = stored(spark, sf_dir, "nation", on_delete=hook)
    s.delete("nation", [2, 3])
    return spark.createDataFrame([(n,) for n in hook.seen], "n_name string")


def _vacuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after two updates and a vacuum, and whether a second one finds anything."""
    s = stored(spark, sf_dir, "nation")
    for k in (1, 2):
        s.persist("nation", s.table("nation").where(f"n_nationkey < {k}").withColumn("n_name", F.lit("V")))
        s.commit()
    s.store.vacuum()
    return s.table("nation").withColumn("left_over", F.lit(s.store.vacuum()).cast("long"))


def _content(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    return spark.createDataFrame(list(s.content("nation")), s.catalog["nation"].schema)


def _find(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    return spark.createDataFrame([s.find("nation", 7), s.find("nation", 12)], s.catalog["nation"].schema)


def _own_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.register_aggregate("SPREAD", lambda c: F.max(c) - F.min(c))
    return s.execute("SELECT o_orderstatus, SPREAD(o_custkey) spread FROM orders GROUP BY o_orderstatus")


#: statement: the error that it must give
REJECTED = {
    "SELECT n_name FROM nation GROUP BY n_name": "InvalidGroupColumnSet",
    "SELECT n_name, COUNT(n_nationkey) n FROM nation": "InvalidGroupColumnSet",
    "SELECT COUNT(n_nationkey) n FROM nation GROUP BY n_name": "InvalidGroupColumnSet",
    "SELECT n_name, n_regionkey, COUNT(n_nationkey) n FROM nation GROUP BY n_name": "InvalidGroupColumnSet",
    "SELECT n_name FROM nation GROUP BY nothing": "InvalidGroupByPart",
    "SELECT event_id, COUNT(event_id) n FROM events GROUP BY event_id WINDOW BY event_id INTERVAL = 3": "InvalidSQLStatement",
    "SELECT event_id FROM events WINDOW BY event_id INTERVAL = 3 ORDER BY event_id": "InvalidSQLStatement",
    "SELECT event_id FROM events WINDOW BY nothing INTERVAL = 3": "InvalidWindowByPart",
    "SELECT n_name FROM nation ORDER BY nothing": "InvalidOrderByPart",
    "SELECT n_name": "MissingFromClause",
    "PROCESS orders": "MissingWithinClause",
    "SELECT a.n_name FROM nation b": "InvalidColumnDescription",
    "SELECT n_name FROM nation a, nation b": "AmbiguousColumnName",
    "SELECT n_name FROM nation WHERE n_name > 5": "InvalidConditionValue",
    "SELECT n_name FROM nation WHERE (n_regionkey = 1": "MissingRightParenthesis",
    "CONNECT root/root": "UnsupportedStatement",
    "ALTER SYSTEM SHUTDOWN INSTANCE": "UnsupportedStatement",
}


def _rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, out = session(spark, sf_dir), []
    for text in REJECTED:
        try:
            s.execute(text)
            out.append((text, None))
        except E.DialectError as e:
            out.append((text, type(e).__name__))
    return spark.createDataFrame(out, "statement string, error string")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a session has done what."""
    s = stored(spark, sf_dir, "nation")
    s.execute("SELECT n_name FROM nation")
    s.delete("nation", [1])
    s.execute("COMMIT")
    return spark.createDataFrame([(name, n) for name, n, *_ in s.metrics.rows()], "name string, n long")


def _live(statement: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return session(spark, sf_dir).execute(statement).start(once=True).results()

    return run


def _stream_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of a stored table over three starts: its rows at first, an insert and an update, and nothing uncommitted."""
    s, output = stored(spark, sf_dir, "nation"), f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = lambda: s.execute("SELECT STREAM n_nationkey, n_name FROM nation").start(once=True, output=f"{output}/rows", checkpoint=f"{output}/checkpoint")
    t = other(s)
    t.persist("nation", [{"n_nationkey": 100, "n_name": "UNCOMMITTED"}])
    stream()
    t.rollback()
    s.persist("nation", [{"n_nationkey": 101, "n_name": "INSERTED"}, {"n_nationkey": 5, "n_name": "UPDATED"}])
    s.commit()
    stream()
    s.delete("nation", [1])
    s.commit()
    return stream().results()


class KeepsOdd:
    """A processor that removes rows of even ids."""

    def process(self, row: dict) -> bool:
        return row["event_id"] % 2 == 0

    def delete(self) -> bool:
        return True


def _process_stream(kept_in_store: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = stored(spark, sf_dir, "events") if kept_in_store else session(spark, sf_dir)
        if kept_in_store:
            other(s).persist("events", [{"event_id": -1, "event_type": "click"}])  # never committed
        output = f"{shared_dir(spark)}/process-{uuid.uuid4().hex}"
        statement = parse("PROCESS STREAM events WITHIN millrace.testdata.KeepsOdd WHERE event_type = 'click'")
        s.process_stream(statement, output=output, once=True)
        return spark.read.schema(s.catalog["events"].schema).parquet(f"{output}/batch=*")

    return run


def _stream_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as a callback has got them."""
    s, got = stored(spark, sf_dir, "region"), []
    consume(s.execute("SELECT STREAM r_regionkey, r_name FROM region").start(once=True), got.append)
    return spark.createDataFrame([(r["r_regionkey"], r["r_name"]) for r in got], "r_regionkey int, r_name string")


def _stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-row windows over the events in two commits, the second one followed after a restart."""
    s, output = stored(spark, sf_dir, "events"), f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    start = lambda: s.execute(STREAM_WINDOW).start(once=True, output=f"{output}/rows", checkpoint=f"{output}/checkpoint")
    start()
    s.persist("events", spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("event_id", F.col("event_id") + 10_000_000))
    s.commit()
    return start().results()


def _stream_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream gave up to its stop, with commits before and after."""
    s = stored(spark, sf_dir, "region")
    stream = s.execute("SELECT STREAM r_regionkey, r_name FROM region").start()
    stream.results()
    stream.stop()
    s.persist("region", [{"r_regionkey": 50, "r_name": "LATE"}])
    s.commit()
    return stream.results()


def _nulls(spark: SparkSession, sf_dir: str) -> Session:
    """Events of which every third has no user, every fifth no type and every seventh no value, with users beyond 2^53."""
    s = stored(spark, sf_dir, "events")
    rows = s.table("events").where("event_id < 600")
    rows = rows.withColumn("user_id", F.expr("CASE WHEN event_id % 3 = 0 THEN NULL ELSE 9007199254740993 + user_id END"))
    rows = rows.withColumn("event_type", F.expr("CASE WHEN event_id % 5 > 0 THEN event_type END")).withColumn("value", F.expr("CASE WHEN event_id % 7 > 0 THEN value END"))
    t = Session(spark, s.catalog, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    t.persist("events", rows)
    t.commit()
    return t


NULLS_SQL = """(SELECT event_id, CASE WHEN event_id % 3 > 0 THEN 9007199254740993 + user_id END AS user_id,
    CASE WHEN event_id % 5 > 0 THEN event_type END AS event_type, CASE WHEN event_id % 7 > 0 THEN value END AS value FROM events WHERE event_id < 600)"""
NULLS_WINDOW = "SELECT STREAM event_id, COUNT(user_id) n, SUM(user_id) total, MIN(value) low, LAST(event_type) latest FROM events WINDOW BY event_id INTERVAL = 4"


def _dates(spark: SparkSession, sf_dir: str) -> Session:
    """Order dates as text, every tenth as no date."""
    s = Session(spark, Catalog([Entity("texts", StructType.fromDDL("k long, t string"), id="k")]), f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    text = F.expr("CASE WHEN o_orderkey % 10 = 0 THEN '99.' ELSE '' END || date_format(o_orderdate, 'dd.MM.yyyy')")
    s.persist("texts", spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), text.alias("t")))
    s.commit()
    return s


def _replayed(statement: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: session(spark, sf_dir).replay(statement)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: (lambda spark, d, text=text: session(spark, d).execute(text)) for n, (text, _) in STATEMENTS.items()}
    out["sum_double"] = lambda spark, d: session(spark, d).execute("SELECT l_returnflag, SUM(l_quantity) total FROM lineitem GROUP BY l_returnflag").withColumn("total", F.round("total", 2))
    out["avg_double"] = lambda spark, d: session(spark, d).execute("SELECT l_returnflag, AVG(l_quantity) mean FROM lineitem GROUP BY l_returnflag").withColumn("mean", F.round("mean", 6))
    out |= {"run_group": _replayed(STREAM_RUN), "run_group_filtered": _replayed(STREAM_RUN.replace("GROUP BY", "WHERE user_id > 10 GROUP BY"))}
    out |= {"stream_run_group": _live(STREAM_RUN), "stream_count_window": _live(STREAM_WINDOW), "stream_filter": _live(STREAM_FILTER), "stream_join": _live(STREAM_JOIN)}
    out |= {"stream_stored": _stream_stored, "stream_callback": _stream_callback, "stream_restart": _stream_restart, "stream_stop": _stream_stop}
    out["stream_window_nulls"] = lambda spark, d: _nulls(spark, d).execute(NULLS_WINDOW).start(once=True).results()
    out["replay_window_nulls"] = lambda spark, d: _nulls(spark, d).replay(NULLS_WINDOW)
    out["stream_run_nulls"] = lambda spark, d: _nulls(spark, d).execute(STREAM_RUN).start(once=True).results()
    out |= {"process_delete": _process, "process_stored": _stored_process, "process_stream": _process_stream(False), "process_stream_stored": _process_stream(True)}
    out |= {"upsert": _upsert, "delete_by_id": _delete, "purge": _purge, "rollback": _rollback, "new_entity": _new_entity, "generated_ids": _generated_ids}
    out |= {"read_committed": _isolation("read committed"), "serializable": _isolation("serializable"), "table_lock": _table_lock, "duplicates": _duplicates}
    out |= {"on_delete": _on_delete, "vacuum": _vacuum, "table_content": _content, "find": _find, "own_aggregate": _own_aggregate, "rejected": _rejected, "metrics": _metrics}
    out["to_date"] = lambda spark, d: _dates(spark, d).execute("SELECT k, TO_DATE(t) day FROM texts")
    return out


def oracle_sql() -> dict[str, str]:
    out = {n: sql for n, (_, sql) in STATEMENTS.items()}
    out["sum_double"] = "SELECT l_returnflag, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY l_returnflag"
    out["avg_double"] = "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY l_returnflag"
    out |= {"run_group": RUN_SQL.format(where="true"), "run_group_filtered": RUN_SQL.format(where="user_id > 10"), "stream_run_group": RUN_SQL.format(where="true")}
    out["stream_count_window"] = STATEMENTS["count_window_10"][1]
    out["stream_filter"] = "SELECT event_id, event_type, value FROM events WHERE event_type IN ('purchase', 'error') AND value > 50.0"
    stays = "NOT (o_custkey % 2 = 0 AND o_orderkey % 10 <> 3)"
    out["process_delete"] = out["process_stored"] = f"SELECT * FROM orders WHERE o_orderstatus <> 'F' OR {stays}"
    out["process_stream"] = out["process_stream_stored"] = "SELECT * FROM events WHERE event_type = 'click' AND event_id % 2 = 1"
    out["stream_join"] = "SELECT event_id, c_name, value FROM events JOIN customer ON user_id = c_custkey WHERE value > 100.0"
    out["stream_stored"] = "SELECT n_nationkey, n_name FROM nation UNION ALL VALUES (101::INT, 'INSERTED'), (5, 'UPDATED')"
    out["stream_callback"] = out["stream_stop"] = "SELECT * FROM region"
    twice = "(SELECT * FROM events UNION ALL SELECT * REPLACE (event_id + 10000000 AS event_id) FROM events)"
    out["stream_restart"] = STATEMENTS["count_window_10"][1].replace("FROM events", f"FROM {twice}")
    out["stream_run_nulls"] = RUN_SQL.format(where="true").replace("FROM events", f"FROM {NULLS_SQL}").replace("arg_max(value, event_id)", "arg_max_null(value, event_id)")
    out["stream_window_nulls"] = out["replay_window_nulls"] = f"""SELECT event_id, n, total, low, latest FROM (SELECT first(event_id) OVER w AS event_id, count(user_id) OVER w AS n,
        (sum(user_id) OVER w)::BIGINT AS total, min(value) OVER w AS low, last(event_type) OVER w AS latest, count(*) OVER w AS full_rows
        FROM {NULLS_SQL} WINDOW w AS (ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) WHERE full_rows = 4"""
    out["purge"] = "SELECT * FROM nation WHERE n_nationkey NOT IN (3, 5)"
    out["new_entity"] = "SELECT * FROM nation WHERE n_nationkey <> 7 UNION ALL VALUES (100::INT, 'NEW', NULL::INT), (7, NULL, NULL)"
    out["generated_ids"] = "SELECT * FROM (VALUES (1::BIGINT, 'a'), (2, 'b'), (3, 'c'), (67, 'd'), (133, 'e')) v(id, name)"
    seen = "SELECT 'before' AS seen, n_nationkey FROM nation UNION ALL SELECT 'after', n_nationkey FROM nation"
    out |= {"serializable": seen, "read_committed": f"{seen} WHERE n_nationkey NOT IN (1, 2)"}
    out["table_lock"] = f"SELECT 'UnableToLockTableForProcess' AS error, count(*) AS n FROM orders WHERE {stays}"
    out["duplicates"] = "SELECT 4::INT AS n_nationkey, 2::BIGINT AS rows"
    out["on_delete"] = "SELECT n_name FROM nation WHERE n_nationkey IN (2, 3)"
    out["vacuum"] = "SELECT * REPLACE (CASE WHEN n_nationkey < 2 THEN 'V' ELSE n_name END AS n_name), 0::BIGINT AS left_over FROM nation"
    out["table_content"] = "SELECT * FROM nation"
    out["find"] = "SELECT * FROM nation WHERE n_nationkey IN (7, 12)"
    out["own_aggregate"] = "SELECT o_orderstatus, max(o_custkey) - min(o_custkey) AS spread FROM orders GROUP BY ALL"
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    out["rejected"] = f"SELECT * FROM (VALUES {', '.join(f'({quoted(a)}, {quoted(b)})' for a, b in REJECTED.items())}) v(statement, error)"
    out["metrics"] = "SELECT * FROM (VALUES ('commit', 1::BIGINT), ('delete', 1), ('parse', 2), ('persist', 1), ('select', 1)) v(name, n)"
    out["to_date"] = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 <> 0 THEN date_trunc('day', o_orderdate)::TIMESTAMP END AS day FROM orders"
    out["upsert"] = """SELECT * REPLACE (CASE WHEN o_orderkey % 100 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus) FROM orders
        UNION ALL SELECT * REPLACE (o_orderkey + 100000000 AS o_orderkey) FROM orders WHERE o_orderkey % 100 = 1"""
    out["delete_by_id"] = "SELECT * FROM orders WHERE o_orderkey % 7 <> 0"
    out["rollback"] = "SELECT * FROM orders"
    return out
