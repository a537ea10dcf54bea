"""Every query of the driver's contract, with the SQL it must agree with.

The tables are read through models; money is bound as decimal(18,2) by the source mapping, as exact sums take no floats.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from . import types as t
from .expr import bind_value, call, lit, null, parameter
from .functions import SemanticFunction
from .model import Model, ModelBuilder, present
from .operators.evaluation import evaluate_binary, evaluate_regression
from .operators.vector import exact_search
from .operators.writes import delete, update
from .plans import pipeline as p
from .plans.pipeline import Pipeline, Rows
from .session import Engine, repeated, unreferenced
from .sources import parquet

KEY = replace(t.U64, stored="long")
MONEY = t.decimal(18, 2)

REGION = ModelBuilder("tpch/region").field("r_regionkey", t.I32).field("r_name", t.STRING).identity("r_regionkey").freeze()
NATION = ModelBuilder("tpch/nation").field("n_nationkey", t.I32).field("n_name", t.STRING).field("n_regionkey", t.I32).identity("n_nationkey").freeze()
CUSTOMER = (
    ModelBuilder("tpch/customer").field("c_custkey", KEY).field("c_name", t.STRING).field("c_nationkey", t.I32).field("c_acctbal", MONEY).field("c_mktsegment", t.STRING)
    .identity("c_custkey").freeze()
)
SUPPLIER = ModelBuilder("tpch/supplier").field("s_suppkey", KEY).field("s_name", t.STRING).field("s_nationkey", t.I32).field("s_acctbal", MONEY).identity("s_suppkey").freeze()
PART = ModelBuilder("tpch/part").field("p_partkey", KEY).field("p_name", t.STRING).field("p_brand", t.STRING).field("p_type", t.STRING).field("p_size", t.I32).field("p_retailprice", t.F64).identity("p_partkey").freeze()
ORDERS = (
    ModelBuilder("tpch/orders").field("o_orderkey", KEY).field("o_custkey", KEY).field("o_orderstatus", t.STRING).field("o_totalprice", MONEY)
    .field("o_orderdate", t.LOCAL).field("o_orderpriority", t.STRING).identity("o_orderkey")
    .reference("tpch/customer", ("o_custkey",), ("c_custkey",)).freeze()
)
#: Its order and line numbers repeat, so it has no identity.
LINEITEM = (
    ModelBuilder("tpch/lineitem").field("l_orderkey", KEY).field("l_partkey", KEY).field("l_suppkey", KEY).field("l_linenumber", t.I32).field("l_quantity", t.I64)
    .field("l_extendedprice", MONEY).field("l_discount", t.F64).field("l_returnflag", t.STRING).field("l_linestatus", t.STRING).field("l_shipdate", t.LOCAL).freeze()
)
EVENTS = ModelBuilder("app/events").field("event_id", KEY).field("at", t.INSTANT, "ts").field("user_id", KEY).field("event_type", t.STRING).field("value", t.F64).identity("event_id").freeze()
LOCAL_EVENTS = ModelBuilder("app/local_events").field("event_id", KEY).field("ts", t.LOCAL).identity("event_id").freeze()
DOCUMENTS = ModelBuilder("text/documents").field("doc_id", t.I64).field("text", t.STRING).field("lang", t.STRING).identity("doc_id").freeze()
EMBEDDINGS = ModelBuilder("text/embeddings").field("vec_id", KEY).field("embedding", t.list_of(t.F32)).field("label", t.I32).identity("vec_id").freeze()
LABELS = ModelBuilder("text/labels").field("doc_id", t.I64).field("quality", t.I32).field("toxic", t.I32).freeze()

FILES = {
    "region": REGION, "nation": NATION, "customer": CUSTOMER, "supplier": SUPPLIER, "part": PART, "orders": ORDERS, "lineitem": LINEITEM,
    "events": EVENTS, "documents": DOCUMENTS, "embeddings": EMBEDDINGS, "labels": LABELS,
}

#: Types of the files where they are not the models'.
STORED_AS = {**dict.fromkeys(("c_acctbal", "s_acctbal", "o_totalprice", "l_quantity", "l_extendedprice"), "double"), "ts": "timestamp_ntz"}


def engine(spark: SparkSession, sf_dir: str, *models: Model) -> Engine:
    spark.conf.set("spark.sql.ansi.enabled", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = Engine(spark)
    for name, m in [*FILES.items(), ("events", LOCAL_EVENTS)]:
        if not models or m in models:
            e.bind(m, parquet.read(spark, f"{sf_dir}/{name}.parquet", m, stored_as=STORED_AS))
    return e


def src(m: Model) -> Pipeline:
    return Pipeline.from_model(m)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ORDERS
    return engine(spark, sf_dir, o).execute(
        src(o).filter(o["o_orderstatus"].eq("F")).aggregate_by({"o_orderpriority": o["o_orderpriority"]}, {"n": p.count(), "total": p.sum_(o["o_totalprice"])})
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"flagship": flagship}
SQL: dict[str, str] = {
    "flagship": "SELECT o_orderpriority, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority"
}


def query(sql: str | None, *models: Model):
    """Registers a function of nothing that gives a pipeline, or of an engine that gives a data frame."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            e = engine(spark, sf_dir, *models)
            got = f(e) if f.__code__.co_argcount else f()
            return e.execute(got) if isinstance(got, Pipeline) else got

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


#: A customer's segment, of which some are missing and some null.
SEGMENTS = ModelBuilder("tpch/segments").field("c_custkey", KEY).optional_field("c_mktsegment", t.STRING.nullable()).field("c_name", t.STRING.nullable()).identity("c_custkey").freeze()

C, O, L, N, R, S, P, E, D, V = CUSTOMER, ORDERS, LINEITEM, NATION, REGION, SUPPLIER, PART, EVENTS, DOCUMENTS, EMBEDDINGS


# --- filters, projections, slices -------------------------------------------------------------------------------------
@query("SELECT c_custkey, c_name FROM customer WHERE (c_acctbal >= 1000 AND c_mktsegment <> 'BUILDING') OR c_nationkey = 3", C)
def filter_3vl():
    return src(C).filter((C["c_acctbal"].ge(1000) & C["c_mktsegment"].ne("BUILDING")) | C["c_nationkey"].eq(3)).select({"c_custkey": C["c_custkey"], "c_name": C["c_name"]})


@query("SELECT o_orderpriority AS value FROM orders", O)
def project_scalar():
    return src(O).select(O["o_orderpriority"])


@query('SELECT o_orderkey AS "_1", o_orderstatus AS "_2" FROM orders', O)
def project_tuple():
    return src(O).select((O["o_orderkey"], O["o_orderstatus"]))


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders", O)
def project_record():
    return src(O).select(p.record(("status", O["o_orderstatus"]), ("id", O["o_orderkey"])))


@query("SELECT * FROM region", R)
def model_output():
    return src(R)


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey DESC, o_orderkey LIMIT 50 OFFSET 7", O)
def slice_offset():
    return src(O).order_by(O["o_orderkey"]).order_by_desc(O["o_custkey"]).slice(7, 50).select({"o_orderkey": O["o_orderkey"], "o_custkey": O["o_custkey"]})


@query("SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS price FROM orders ORDER BY CAST(o_totalprice AS DECIMAL(18,2)) DESC, o_orderkey LIMIT 20", O)
def sort_chain_topk():
    return src(O).order_by(O["o_orderkey"]).order_by_desc(O["o_totalprice"]).limit(20).select({"o_orderkey": O["o_orderkey"], "price": O["o_totalprice"]})


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 14000", O)
def offset_only():
    return src(O).order_by(O["o_orderkey"]).offset(14000).select({"o_orderkey": O["o_orderkey"]})


# --- expressions ------------------------------------------------------------------------------------------------------
@query(
    "SELECT l_orderkey, l_linenumber * 3 + 1 AS a, l_linenumber - 10 AS b, CAST(trunc((l_linenumber - 10) / 4.0) AS INTEGER) AS c, "
    "(l_linenumber - 10) % 4 AS d, -l_linenumber AS e, abs(l_linenumber - 10) AS f, CAST(l_linenumber AS BIGINT) AS g FROM lineitem",
    L,
)
def arith_checked():
    n = L["l_linenumber"]
    return src(L).select(
        {"l_orderkey": L["l_orderkey"], "a": n * 3 + 1, "b": n - 10, "c": (n - 10) / 4, "d": (n - 10) % 4, "e": -n, "f": (n - 10).abs(), "g": n.cast(t.I64)}
    )


# SQL's zero has no sign here, division's has one: adding 0 makes -0 positive and leaves all else
@query("SELECT l_orderkey, l_linenumber, CAST(l_discount * 2 + 1 - l_discount AS DOUBLE) AS x, CASE WHEN l_discount = 0 THEN 'Infinity'::DOUBLE ELSE 1 / l_discount END AS y FROM lineitem", L)
def float_arithmetic():
    d = L["l_discount"]
    return src(L).select({"l_orderkey": L["l_orderkey"], "l_linenumber": L["l_linenumber"], "x": d * 2.0 + 1.0 - d, "y": lit(1.0, t.F64) / (d + 0.0)})


@query("SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) * CAST(1.10 AS DECIMAL(3,2)) AS gross FROM orders", O)
def decimal_arithmetic():
    import decimal

    return src(O).select({"o_orderkey": O["o_orderkey"], "gross": O["o_totalprice"] * lit(decimal.Decimal("1.10"), t.decimal(3, 2))})


# whole numbers of cents, and rounding by whole numbers: SQL's own division of decimals is by doubles
@query(
    "WITH c AS (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS HUGEINT) AS n FROM orders), "
    "q AS (SELECT o_orderkey, (2 * n * 1000000000000000000::HUGEINT + 700) // 1400 AS q FROM c) "
    "SELECT o_orderkey, CAST(CAST(q // 1000000000000000000::HUGEINT AS VARCHAR) || '.' || lpad(CAST(q % 1000000000000000000::HUGEINT AS VARCHAR), 18, '0') AS DECIMAL(38,18)) AS share FROM q",
    O,
)
def decimal_division():
    import decimal

    return src(O).select({"o_orderkey": O["o_orderkey"], "share": O["o_totalprice"] / lit(decimal.Decimal("7.00"), t.decimal(3, 2))})


@query("SELECT p_partkey, p_retailprice < 1000 AS lt, p_retailprice >= 1500.5 AS ge, p_retailprice <> 900 AS ne FROM part", P)
def float_compare():
    x = P["p_retailprice"]
    return src(P).select({"p_partkey": P["p_partkey"], "lt": x.lt(1000.0), "ge": x.ge(1500.5), "ne": x.ne(900.0)})


@query(
    "SELECT c_custkey, x.o_orderkey IS DISTINCT FROM c_custkey AS d, x.o_orderkey IS NOT DISTINCT FROM c_custkey AS n, x.o_orderkey IS NULL AS z "
    "FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') x ON o_custkey = c_custkey",
    C, O,
)
def null_safe_compare():
    urgent = src(O).filter(O["o_orderpriority"].eq("1-URGENT"))
    k = O["o_orderkey"].nullable()
    return src(C).left_join(urgent, O["o_custkey"].eq(C["c_custkey"])).select(
        {"c_custkey": C["c_custkey"], "d": k.is_distinct_from(C["c_custkey"].nullable()), "n": k.is_not_distinct_from(C["c_custkey"].nullable()), "z": k.is_null()}
    )


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM')", O)
def membership():
    return src(O).filter(O["o_orderpriority"].is_in(["3-MEDIUM", "1-URGENT"])).select({"o_orderkey": O["o_orderkey"]})


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '3-MEDIUM')", O)
def not_membership():
    return src(O).filter(O["o_orderpriority"].not_in(["3-MEDIUM", "1-URGENT"])).select({"o_orderkey": O["o_orderkey"]})


@query("SELECT o_orderkey, o_orderkey BETWEEN 100 AND 5000 AS a, o_orderkey NOT BETWEEN 100 AND 5000 AS b FROM orders", O)
def between():
    k = O["o_orderkey"]
    return src(O).select({"o_orderkey": k, "a": k.between(100, 5000), "b": k.not_between(100, 5000)})


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE o_orderstatus END AS size FROM orders", O)
def conditional():
    return src(O).select({"o_orderkey": O["o_orderkey"], "size": O["o_totalprice"].gt(100000).if_else("big", O["o_orderstatus"])})


@query(
    "SELECT c_custkey, coalesce(x.o_orderkey, 0) AS k, coalesce(x.o_orderpriority, 'none') AS pr FROM customer "
    "LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') x ON o_custkey = c_custkey",
    C, O,
)
def coalesce():
    urgent = src(O).filter(O["o_orderpriority"].eq("1-URGENT"))
    return src(C).left_join(urgent, O["o_custkey"].eq(C["c_custkey"])).select(
        {"c_custkey": C["c_custkey"], "k": O["o_orderkey"].nullable().coalesce(0), "pr": O["o_orderpriority"].nullable().coalesce("none")}
    )


def _segments(e: Engine) -> Pipeline:
    """Missing where the nation is divisible by three, else null where it is divisible by four."""
    df = e.table(C).selectExpr(
        "c_custkey", "CASE WHEN c_nationkey % 3 <> 0 AND c_nationkey % 4 <> 0 THEN c_mktsegment END AS c_mktsegment", f"c_nationkey % 3 <> 0 AS `{present('c_mktsegment')}`",
        "CASE WHEN c_nationkey % 5 <> 0 THEN c_name END AS c_name",
    )
    e.bind(SEGMENTS, df)
    return src(SEGMENTS)


_SEGMENTS_SQL = """(SELECT c_custkey, CASE WHEN c_nationkey % 3 <> 0 AND c_nationkey % 4 <> 0 THEN c_mktsegment END AS seg, c_nationkey % 3 = 0 AS gone,
CASE WHEN c_nationkey % 5 <> 0 THEN c_name END AS name FROM customer)"""


@query(f"SELECT c_custkey, gone AS m, NOT gone AS p, seg IS NULL AND NOT gone AS z FROM {_SEGMENTS_SQL}", C)
def missing_and_null(e: Engine):
    x = SEGMENTS["c_mktsegment"]
    return e.execute(_segments(e).select({"c_custkey": SEGMENTS["c_custkey"], "m": x.is_missing(), "p": x.is_present(), "z": x.is_null()}))


@query(f"SELECT c_custkey, coalesce(seg, name) AS v FROM {_SEGMENTS_SQL} WHERE NOT gone", C)
def coalesce_nullable(e: Engine):
    x = SEGMENTS["c_mktsegment"]
    return e.execute(_segments(e).filter(x.is_present()).select({"c_custkey": SEGMENTS["c_custkey"], "v": x.coalesce_nullable(SEGMENTS["c_name"])}))


class _Priority:
    """A foreign class, bound to the names that the table has."""

    type = t.STRING

    @staticmethod
    def encode(value: int) -> str:
        return {1: "1-URGENT", 2: "2-HIGH"}[value]


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'", O)
def bound_value():
    return src(O).filter(O["o_orderpriority"].eq(bind_value(_Priority, 1))).select({"o_orderkey": O["o_orderkey"]})


_SCALED = SemanticFunction("example.org/scaled", 1, (t.I32, t.F64), t.F64, lambda a, b: a * b)


@query("SELECT p_partkey, p_size * p_retailprice AS scaled FROM part", P)
def custom_function_of_two():
    return src(P).select({"p_partkey": P["p_partkey"], "scaled": call(_SCALED, P["p_size"], P["p_retailprice"])})


@query("SELECT r_regionkey, CAST(NULL AS VARCHAR) AS nothing, TRUE AS yes, 7 AS seven FROM region", R)
def literals():
    return src(R).select({"r_regionkey": R["r_regionkey"], "nothing": null(t.STRING), "yes": lit(True, t.BOOL), "seven": lit(7, t.I32)})


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH' AND o_totalprice > 50000", O)
def parameterised_filter(e: Engine):
    q = src(O).filter(O["o_orderpriority"].eq(parameter("priority", t.STRING)) & O["o_totalprice"].gt(parameter("least", MONEY)))
    return e.execute(q.select({"o_orderkey": O["o_orderkey"]}), priority="2-HIGH", least=50000)


_TWICE = SemanticFunction("example.org/twice", 1, (t.I32,), t.I32, lambda c: c * 2)


@query("SELECT p_partkey, p_size * 2 AS twice FROM part", P)
def custom_function():
    return src(P).select({"p_partkey": P["p_partkey"], "twice": call(_TWICE, P["p_size"])})


# --- text and time ----------------------------------------------------------------------------------------------------
@query(
    "SELECT p_partkey, lower(p_type) AS lo, upper(p_name) AS up, trim(p_type || '') AS tr, strlen(p_name) AS n, length(p_name) AS s, p_name = '' AS z FROM part", P
)
def text_functions():
    return src(P).select(
        {"p_partkey": P["p_partkey"], "lo": P["p_type"].to_lowercase(), "up": P["p_name"].to_uppercase(), "tr": P["p_type"].trim(), "n": P["p_name"].len(), "s": P["p_name"].scalar_len(), "z": P["p_name"].is_empty()}
    )


@query("SELECT doc_id, strlen(text) AS n, length(text) AS s, contains(text, ' the ') AS has, starts_with(text, 'The') AS st, ends_with(text, '.') AS en FROM documents", D)
def text_predicates():
    x = D["text"]
    return src(D).select({"doc_id": D["doc_id"], "n": x.len(), "s": x.scalar_len(), "has": x.contains(" the "), "st": x.starts_with("The"), "en": x.ends_with(".")})


@query("SELECT doc_id, regexp_replace(text, '^\\s+', '') AS a, regexp_replace(text, '\\s+$', '') AS b FROM documents", D)
def text_trims():
    return src(D).select({"doc_id": D["doc_id"], "a": D["text"].trim_start(), "b": D["text"].trim_end()})


@query(
    "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS TINYINT) AS m, CAST(day(o_orderdate) AS SMALLINT) AS d, "
    "CAST(dayofyear(o_orderdate) AS INTEGER) AS o, CAST(isodow(o_orderdate) AS TINYINT) AS w FROM orders",
    O,
)
def date_parts():
    d = O["o_orderdate"].date()
    return src(O).select({"o_orderkey": O["o_orderkey"], "y": d.year(), "m": d.month(), "d": d.day(), "o": d.ordinal(), "w": d.weekday()})


@query("SELECT event_id, (epoch_us(ts) % 86400000000) * 1000 AS clock FROM events", LOCAL_EVENTS)
def clock_time():
    return src(LOCAL_EVENTS).select({"event_id": LOCAL_EVENTS["event_id"], "clock": LOCAL_EVENTS["ts"].time()})


@query("SELECT user_id, event_id, CAST(trunc(event_id * 1.5) AS BIGINT) AS s FROM events", E)
def whole_seconds(e: Engine):
    """Durations of a second and a half for each event number, cut to whole seconds."""
    d = SemanticFunction("example.org/sesquiseconds", 1, (KEY,), t.DURATION, lambda c: c * 1_500_000_000)
    return src(E).select({"user_id": E["user_id"], "event_id": E["event_id"], "s": call(d, E["event_id"]).whole_seconds()})


@query(
    "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events", E
)
def instant_epoch():
    return src(E).select({"event_id": E["event_id"], "s": E["at"].unix_timestamp()})


# --- joins ------------------------------------------------------------------------------------------------------------
@query('SELECT n_name AS "_1", r_name AS "_2" FROM nation JOIN region ON n_regionkey = r_regionkey', N, R)
def inner_join():
    return src(N).join(src(R), N["n_regionkey"].eq(R["r_regionkey"])).select((N["n_name"], R["r_name"]))


_FEW = src(O).filter(O["o_totalprice"].gt(150000))


@query(
    'SELECT c_custkey AS "customer.c_custkey", c_name AS "customer.c_name", c_nationkey AS "customer.c_nationkey", c_acctbal::DECIMAL(18,2) AS "customer.c_acctbal", '
    'c_mktsegment AS "customer.c_mktsegment", x.o_orderkey AS "orders.o_orderkey", x.o_custkey AS "orders.o_custkey", x.o_orderstatus AS "orders.o_orderstatus", '
    'x.o_totalprice::DECIMAL(18,2) AS "orders.o_totalprice", x.o_orderdate AS "orders.o_orderdate", x.o_orderpriority AS "orders.o_orderpriority", '
    'x.o_orderkey IS NOT NULL AS "orders.matched" FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 150000) x ON o_custkey = c_custkey',
    C, O,
)
def left_join():
    return src(C).left_join(_FEW, O["o_custkey"].eq(C["c_custkey"]))


@query("SELECT c_custkey AS c, x.o_orderkey AS o FROM (SELECT * FROM orders WHERE o_totalprice > 150000) x RIGHT JOIN customer ON o_custkey = c_custkey", C, O)
def right_join():
    return _FEW.right_join(src(C), O["o_custkey"].eq(C["c_custkey"])).select({"c": C["c_custkey"], "o": O["o_orderkey"].nullable()})


@query("SELECT c_custkey AS c, s_suppkey AS s FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 2 AND c_nationkey < s_nationkey", C, S)
def full_join():
    on = C["c_custkey"].eq(S["s_suppkey"] * 2) & C["c_nationkey"].lt(S["s_nationkey"])  # leaves rows without a partner on both sides
    return src(C).full_join(src(S), on).select({"c": C["c_custkey"].nullable(), "s": S["s_suppkey"].nullable()})


@query('SELECT n_name AS "_1", r_name AS "_2" FROM nation CROSS JOIN region', N, R)
def cross_join():
    return src(N).cross_join(src(R)).select((N["n_name"], R["r_name"]))


@query('SELECT n_nationkey AS "_1", r_regionkey AS "_2" FROM nation JOIN region ON n_regionkey > r_regionkey', N, R)
def theta_join():
    return src(N).join(src(R), N["n_regionkey"].gt(R["r_regionkey"])).select((N["n_nationkey"], R["r_regionkey"]))


@query('SELECT a.n_name AS "_1", b.n_name AS "_2" FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey', N)
def self_join():
    a, b = (lambda k: N[k].at("a")), (lambda k: N[k].at("b"))
    on = a("n_regionkey").eq(b("n_regionkey")) & a("n_nationkey").lt(b("n_nationkey"))
    return Pipeline.from_model_as(N, "a").join(Pipeline.from_model_as(N, "b"), on).select((a("n_name"), b("n_name")))


@query('SELECT x.r_regionkey AS "x.r_regionkey", x.r_name AS "x.r_name", y.r_regionkey AS "y.r_regionkey", y.r_name AS "y.r_name" FROM region x CROSS JOIN region y', R)
def aliases_apart(e: Engine):
    """Two plans of one engine that differ in their aliases only."""
    pair = lambda a, b: Pipeline.from_model_as(R, a).cross_join(Pipeline.from_model_as(R, b))
    assert e.execute(pair("a", "b")).columns[0] == "a.r_regionkey"
    return e.execute(pair("x", "y"))


@query("SELECT r_name, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", O, C, N, R)
def join_tree():
    j = src(O).join(src(C), O["o_custkey"].eq(C["c_custkey"])).join(src(N), C["c_nationkey"].eq(N["n_nationkey"])).join(src(R), N["n_regionkey"].eq(R["r_regionkey"]))
    return j.aggregate_by({"r_name": R["r_name"]}, {"n": p.count(), "total": p.sum_(O["o_totalprice"])})


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)", C, O)
def exists():
    sub = src(O).filter(O["o_custkey"].eq(C["c_custkey"]) & O["o_totalprice"].gt(150000))
    return src(C).filter(sub.exists()).select({"c_custkey": C["c_custkey"]})


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)", C, O)
def not_exists():
    sub = src(O).filter(O["o_custkey"].eq(C["c_custkey"]) & O["o_totalprice"].gt(150000))
    return src(C).filter(sub.not_exists()).select({"c_custkey": C["c_custkey"]})


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 1 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)", C, O)
def exists_or():
    sub = src(O).filter(O["o_custkey"].eq(C["c_custkey"]) & O["o_totalprice"].gt(150000))
    return src(C).filter(C["c_nationkey"].eq(1) | sub.exists()).select({"c_custkey": C["c_custkey"]})


# --- aggregation, sets ------------------------------------------------------------------------------------------------
@query(
    "SELECT count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS q, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total, min(l_shipdate) AS lo, max(l_shipdate) AS hi, count(l_partkey) AS pk FROM lineitem",
    L,
)
def agg_global():
    return src(L).aggregate(
        {"n": p.count(), "q": p.sum_(L["l_quantity"]), "total": p.sum_(L["l_extendedprice"]), "lo": p.min_(L["l_shipdate"]), "hi": p.max_(L["l_shipdate"]), "pk": p.count_present(L["l_partkey"])}
    )


@query("SELECT count(*) AS n, CAST(sum(l_linenumber) AS INTEGER) AS s, min(l_linenumber) AS lo FROM lineitem WHERE l_orderkey < 0", L)
def agg_global_empty():
    return src(L).filter((L["l_linenumber"] + 0).lt(-5)).aggregate({"n": p.count(), "s": p.sum_(L["l_linenumber"]), "lo": p.min_(L["l_linenumber"])})


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS q, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total, max(l_linenumber) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus", L)
def agg_group_multi():
    keys = {"l_returnflag": L["l_returnflag"], "l_linestatus": L["l_linestatus"]}
    return src(L).aggregate_by(keys, {"n": p.count(), "q": p.sum_(L["l_quantity"]), "total": p.sum_(L["l_extendedprice"]), "hi": p.max_(L["l_linenumber"])})


@query('SELECT o_custkey AS "_1", count(*) AS "_2" FROM orders GROUP BY o_custkey', O)
def agg_group():
    return src(O).aggregate_by(O["o_custkey"], p.count())


@query(
    "SELECT c_nationkey, count(x.o_orderkey) AS n, sum(x.o_totalprice::DECIMAL(18,2)) AS s, min(x.o_orderkey) AS lo, max(x.o_orderkey) AS hi FROM customer "
    "LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 150000) x ON o_custkey = c_custkey GROUP BY c_nationkey",
    C, O,
)
def agg_present():
    k, s = O["o_orderkey"].nullable(), O["o_totalprice"].nullable()
    aggs = {"n": p.count_present(k), "s": p.sum_present(s), "lo": p.min_present(k), "hi": p.max_present(k)}
    return src(C).left_join(_FEW, O["o_custkey"].eq(C["c_custkey"])).aggregate_by({"c_nationkey": C["c_nationkey"]}, aggs)


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", L)
def distinct_rows():
    return src(L).select({"l_returnflag": L["l_returnflag"], "l_linestatus": L["l_linestatus"]}).distinct()


@query("SELECT DISTINCT l_discount AS value FROM lineitem", L)
def distinct_floats():
    return src(L).select(L["l_discount"]).distinct()


_CN, _SN = src(C).select(C["c_nationkey"]), src(S).filter(S["s_nationkey"].lt(12)).select(S["s_nationkey"])


@query("SELECT c_nationkey AS value FROM customer UNION SELECT s_nationkey FROM supplier WHERE s_nationkey < 12", C, S)
def union():
    return _CN.union(_SN)


@query("SELECT c_nationkey AS value FROM customer UNION ALL SELECT s_nationkey FROM supplier WHERE s_nationkey < 12", C, S)
def union_all():
    return _CN.union_all(_SN)


@query("SELECT c_nationkey AS value FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_nationkey < 12", C, S)
def intersect():
    return _CN.intersect(_SN)


@query("SELECT c_nationkey AS value FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey < 12", C, S)
def except_():
    return _CN.except_(_SN)


# --- windows ----------------------------------------------------------------------------------------------------------
def _win(w):
    return src(O).window(w)


def _win_sql(f: str) -> str:
    names = ", ".join(f'{"o_totalprice::DECIMAL(18,2)" if f_.name == "o_totalprice" else f_.name} AS "orders.{f_.name}"' for f_ in O.fields)
    return f"SELECT {names}, {f} AS w FROM orders"


@query(_win_sql("row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)"), O)
def row_number():
    return _win(p.row_number().partition_by(O["o_custkey"]).order_by_desc(O["o_orderdate"]).order_by(O["o_orderkey"]))


@query(_win_sql("rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority)"), O)
def rank():
    return _win(p.rank().partition_by(O["o_custkey"]).order_by(O["o_orderpriority"]))


@query(_win_sql("dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC)"), O)
def dense_rank():
    return _win(p.dense_rank().partition_by(O["o_custkey"]).order_by_desc(O["o_orderpriority"]))


@query(_win_sql("CAST(sum(o_totalprice::DECIMAL(18,2)) OVER (PARTITION BY o_custkey) AS DECIMAL(18,2))"), O)
def window_sum_all():
    return _win(p.window_sum(O["o_totalprice"]).partition_by(O["o_custkey"]).frame(Rows.all()))


@query(_win_sql("CAST(sum(o_totalprice::DECIMAL(18,2)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(18,2))"), O)
def window_sum_running():
    return _win(p.window_sum(O["o_totalprice"]).partition_by(O["o_custkey"]).order_by(O["o_orderkey"]).frame(Rows.to_current()))


@query(_win_sql("CAST(sum(o_totalprice::DECIMAL(18,2)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS DECIMAL(18,2))"), O)
def window_sum_around():
    return _win(p.window_sum(O["o_totalprice"]).partition_by(O["o_custkey"]).order_by(O["o_orderkey"]).frame(Rows.around(2)))


@query(
    "SELECT c_custkey AS c, x.o_orderkey AS o, CAST(sum(x.o_totalprice::DECIMAL(18,2)) OVER (PARTITION BY c_custkey) AS DECIMAL(18,2)) AS w "
    "FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 150000) x ON o_custkey = c_custkey",
    C, O,
)
def window_sum_present(e: Engine):
    j = src(C).left_join(_FEW, O["o_custkey"].eq(C["c_custkey"]))
    got = e.execute(j.window(p.window_sum_present(O["o_totalprice"].nullable()).partition_by(C["c_custkey"]).frame(Rows.all())))
    return got.selectExpr("`customer.c_custkey` as c", "`orders.o_orderkey` as o", f"`{got.columns[-1]}` as w")


# --- lists, vectors, evaluation ---------------------------------------------------------------------------------------
@query("SELECT CAST(unnest(embedding) AS FLOAT) AS value FROM embeddings", V)
def unnest_list():
    return src(V).select(V["embedding"]).unnest()


@query("SELECT CAST(unnest(embedding) AS FLOAT) AS value FROM customer LEFT JOIN embeddings ON vec_id = c_custkey", C, V)
def unnest_present():
    """Customers without a vector have a null list, which gives no rows."""
    return src(C).left_join(src(V), V["vec_id"].eq(C["c_custkey"])).select(V["embedding"].nullable()).unnest_present()


def _target(e: Engine) -> list[float]:
    return [((k * 17 + 3) % 101) / 101 for k in range(64)]


_T = "[" + ",".join(repr(((k * 17 + 3) % 101) / 101) for k in range(64)) + "]::DOUBLE[]"


def _metric_sql(metric: str, down: str = "") -> str:
    return f"SELECT vec_id AS id, round({metric}, 6) AS metric FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, {_T} AS t FROM embeddings) ORDER BY {metric} {down}, vec_id LIMIT 10"


def _search(e: Engine, metric: str) -> DataFrame:
    from pyspark.sql import functions as F

    got = exact_search(e.table(V), "vec_id", "embedding", _target(e), metric, 10)
    return got.select("id", F.round("metric", 6).alias("metric"))


@query(_metric_sql("list_distance(e, t)"), V)
def vector_topk_l2(e: Engine):
    return _search(e, "euclidean")


@query(_metric_sql("list_cosine_similarity(e, t)", "DESC"), V)
def vector_topk_cosine(e: Engine):
    return _search(e, "cosine")


@query(_metric_sql("list_inner_product(e, t)", "DESC"), V)
def vector_topk_ip(e: Engine):
    return _search(e, "inner_product")


@query("SELECT count(*) AS total, count(*) FILTER (quality = toxic) AS correct, avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) AS accuracy FROM labels", LABELS)
def eval_binary(e: Engine):
    return evaluate_binary(e.table(LABELS), "quality", "toxic")


@query("SELECT count(*) AS total, round(avg(pow(value - 50, 2)), 6) AS mse, round(avg(abs(value - 50)), 6) AS mae FROM events", E)
def eval_regression(e: Engine):
    from pyspark.sql import functions as F

    got = evaluate_regression(e.table(E).withColumn("fifty", F.lit(50.0)), "value", "fifty")
    return got.select("total", F.round("mse", 6).alias("mse"), F.round("mae", 6).alias("mae"))


# --- writes -----------------------------------------------------------------------------------------------------------
_CUSTOMER_SQL = "c_custkey, c_name, c_nationkey, c_acctbal::DECIMAL(18,2) AS c_acctbal, c_mktsegment"


@query(
    "SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN c_name ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN c_mktsegment ELSE c_name END AS c_name, "
    "c_custkey, c_nationkey, c_acctbal::DECIMAL(18,2) AS c_acctbal FROM customer",
    C,
)
def update_simultaneous(e: Engine):
    e.apply(update(C).set(C["c_name"], C["c_mktsegment"]).set(C["c_mktsegment"], C["c_name"]).filter(C["c_mktsegment"].eq("BUILDING")))
    return e.table(C)


@query(f"SELECT {_CUSTOMER_SQL} FROM customer WHERE NOT (c_nationkey > 10)", C)
def delete_scoped(e: Engine):
    e.apply(delete(C).filter(C["c_nationkey"].gt(10)))
    return e.table(C)


@query(f"SELECT {_CUSTOMER_SQL} FROM customer UNION ALL SELECT 999999999, 'new', 1, CAST(5 AS DECIMAL(18,2)), 'NONE'", C)
def insert_row(e: Engine):
    from .operators.writes import insert

    tx = e.begin()
    tx.apply(insert(C, {"c_custkey": 999_999_999, "c_name": "new", "c_nationkey": 1, "c_acctbal": 5, "c_mktsegment": "NONE"}))
    tx.commit()
    return e.table(C)


@query(f"SELECT {_CUSTOMER_SQL} FROM customer UNION ALL SELECT 999999990 + range, 'new', 1, CAST(range AS DECIMAL(18,2)), 'NONE' FROM range(3)", C)
def insert_rows(e: Engine):
    from .operators.writes import insert_many

    e.apply(insert_many(C, [{"c_custkey": 999_999_990 + k, "c_name": "new", "c_nationkey": 1, "c_acctbal": k, "c_mktsegment": "NONE"} for k in range(3)]))
    return e.table(C)


@query("SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1", L)
def identity_check(e: Engine):
    """What keeps order and line number from being an identity."""
    return repeated(e.table(L), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)", C, O)
def reference_check(e: Engine):
    tables = {**e.tables, C.key: e.tables[C.key].filter("c_nationkey < 20")}
    return unreferenced(O, C, tables, O.references[0]).select("o_orderkey")


# --- combinations -----------------------------------------------------------------------------------------------------
@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100) x WHERE x.o_custkey = c_custkey)", C, O)
def exists_limit():
    sub = src(O).order_by(O["o_orderkey"]).limit(100).filter(O["o_custkey"].eq(C["c_custkey"]))
    return src(C).filter(sub.exists()).select({"c_custkey": C["c_custkey"]})


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", O)
def group_only():
    return src(O).select({"o_orderstatus": O["o_orderstatus"], "o_orderpriority": O["o_orderpriority"]}).distinct()


@query("SELECT * FROM nation WHERE n_regionkey < 3 EXCEPT SELECT * FROM nation WHERE n_nationkey > 12", N)
def except_models():
    return src(N).filter(N["n_regionkey"].lt(3)).except_(src(N).filter(N["n_nationkey"].gt(12)))


@query("SELECT * FROM (SELECT * FROM nation WHERE n_regionkey < 2 UNION ALL SELECT * FROM nation WHERE n_regionkey > 0)", N)
def union_models():
    return src(N).filter(N["n_regionkey"].lt(2)).union_all(src(N).filter(N["n_regionkey"].gt(0)))


@query(
    "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 150000) x ON o_custkey = c_custkey "
    "ORDER BY o_orderkey ASC NULLS FIRST, c_custkey LIMIT 60",
    C, O,
)
def sort_nulls_first():
    few = src(O).filter(O["o_orderpriority"].eq("1-URGENT") & O["o_totalprice"].gt(150000))
    k = O["o_orderkey"].nullable()
    j = src(C).left_join(few, O["o_custkey"].eq(C["c_custkey"]))
    return j.order_by(C["c_custkey"]).order_by(k).limit(60).select({"c_custkey": C["c_custkey"], "o_orderkey": k})


@query(
    "SELECT o_orderstatus, count(*) AS n FROM orders WHERE (NOT (o_totalprice > 50000 OR o_orderpriority = '5-LOW') AND o_orderkey % 2 = 1) OR o_custkey IN (1, 2, 3) GROUP BY o_orderstatus", O
)
def predicates_mixed():
    c = ((O["o_totalprice"].gt(50000) | O["o_orderpriority"].eq("5-LOW")).negate() & (O["o_orderkey"] % 2).eq(1)) | O["o_custkey"].is_in([1, 2, 3])
    return src(O).filter(c).aggregate_by({"o_orderstatus": O["o_orderstatus"]}, {"n": p.count()})


@query("SELECT s_suppkey, coalesce(p_size, -1) AS size FROM supplier LEFT JOIN (SELECT * FROM part WHERE p_size > 25) x ON p_partkey = s_suppkey WHERE p_partkey IS NULL OR p_size < 40", S, P)
def filter_after_outer_join():
    big = src(P).filter(P["p_size"].gt(25))
    size = P["p_size"].nullable()
    j = src(S).left_join(big, P["p_partkey"].eq(S["s_suppkey"]))
    return j.filter(P["p_partkey"].nullable().is_null() | size.lt(40)).select({"s_suppkey": S["s_suppkey"], "size": size.coalesce(-1)})


@query(f"SELECT {_CUSTOMER_SQL.replace('c_acctbal::DECIMAL(18,2) AS c_acctbal', 'CAST(CASE WHEN c_nationkey = 3 THEN 0 ELSE c_acctbal END AS DECIMAL(18,2)) AS c_acctbal')} FROM customer WHERE c_custkey > 100", C)
def transaction(e: Engine):
    tx = e.begin()
    tx.apply(update(C).set(C["c_acctbal"], 0).filter(C["c_nationkey"].eq(3)))
    tx.apply(delete(C).filter(C["c_custkey"].le(100)))
    tx.commit()
    return e.table(C)
