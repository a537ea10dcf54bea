"""Operators on small tables, with results known by hand."""

import datetime as dt
import random
from decimal import ROUND_HALF_UP, Decimal, localcontext

import pytest

from exactframe import types as t
from exactframe.errors import ExactError
from exactframe.expr import call, lit, null, parameter
from exactframe.functions import SemanticFunction
from exactframe.model import ModelBuilder
from exactframe.operators.writes import delete, insert, insert_many, update
from exactframe.plans import pipeline as p
from exactframe.plans.identity import fingerprint
from exactframe.plans.pipeline import Pipeline, Rows
from exactframe.session import CachePolicy, Engine, Limits, evaluate
from exactframe.values import MISSING

USER = ModelBuilder("t/user").field("id", t.U64).field("organization_id", t.U64).field("score", t.I64).identity("id").freeze()
ORDER = ModelBuilder("t/order").field("id", t.U64).field("user_id", t.U64).field("total", t.I64).identity("id").freeze()
TINY = ModelBuilder("t/tiny").field("id", t.U64).field("group", t.BOOL).field("value", t.I8).identity("id").freeze()
FLOATS = ModelBuilder("t/floats").field("id", t.U64).field("value", t.F64).identity("id").freeze()
NULLS = ModelBuilder("t/nulls").field("id", t.U64).field("value", t.I64.nullable()).identity("id").freeze()
OPT = ModelBuilder("t/opt").field("id", t.U64).optional_field("name", t.STRING.nullable()).field("tags", t.list_of(t.STRING)).identity("id").freeze()
U, O = USER, ORDER


@pytest.fixture()
def e(spark):
    e = Engine(spark)
    e.load(USER, [dict(id=i, organization_id=o, score=s) for i, o, s in ((1, 1, 10), (2, 1, 20), (3, 1, 20), (4, 2, 5))])
    e.load(ORDER, [dict(id=i, user_id=u, total=x) for i, u, x in ((10, 1, 50), (11, 1, 200), (12, 2, 150), (13, 99, 500))])
    e.load(TINY, [dict(id=k, group=True, value=v) for k, v in enumerate((120, 120, -120))])
    e.load(FLOATS, [dict(id=k, value=v) for k, v in enumerate((float("nan"), 0.0, -0.0, float("-inf"), float("inf")))])
    e.load(NULLS, [dict(id=1, value=2), dict(id=2, value=None), dict(id=3, value=1)])
    e.load(OPT, [dict(id=1, name="a", tags=["x", "y"]), dict(id=2, name=None, tags=[]), dict(id=3, tags=["z"])])
    return e


def src(m):
    return Pipeline.from_model(m)


def got(e, q, **kw):
    return [tuple(int(v) if isinstance(v, Decimal) else v for v in r) for r in e.collect(q, **kw)]


def test_joins(e):
    on = U["id"].eq(O["user_id"])
    assert sorted(got(e, src(U).join(src(O), on).select((U["id"], O["id"])))) == [(1, 10), (1, 11), (2, 12)]
    left = got(e, src(U).left_join(src(O), on).select((U["id"], O["id"].nullable())))
    assert sorted(left, key=str) == [(1, 10), (1, 11), (2, 12), (3, None), (4, None)]
    full = got(e, src(U).full_join(src(O), on).select((U["id"].nullable(), O["id"].nullable())))
    assert (None, 13) in full and len(full) == 6
    assert len(got(e, src(U).cross_join(src(O)))) == 16
    flagged = e.execute(src(U).left_join(src(O), on))
    assert flagged.filter("not `order.matched`").count() == 2


def test_outer_side_needs_a_lift(e):
    j = src(U).left_join(src(O), U["id"].eq(O["user_id"]))
    with pytest.raises(ExactError, match="EXPR-SCOPE-006"):
        e.execute(j.select(O["id"]))
    with pytest.raises(ExactError, match="EXPR-SCOPE-001"):
        e.execute(src(U).select(O["id"]))


def test_self_join_needs_aliases(e):
    with pytest.raises(ExactError, match="PIPELINE-SCOPE-001"):
        e.execute(src(U).join(src(U), U["id"].eq(U["id"])))
    a, b = U["id"].at("a"), U["id"].at("b")
    two = Pipeline.from_model_as(U, "a").join(Pipeline.from_model_as(U, "b"), a.lt(b))
    assert len(got(e, two.select((a, b)))) == 6
    with pytest.raises(ExactError, match="EXPR-SCOPE-002"):
        e.execute(two.select(U["id"]))
    with pytest.raises(ExactError, match="PIPELINE-SCOPE-002"):
        e.execute(Pipeline.from_model_as(U, "a").join(Pipeline.from_model_as(O, "a"), U["id"].eq(O["id"])))
    with pytest.raises(ExactError, match="PIPELINE-SCOPE-003"):
        Pipeline.from_model_as(U, "")


def test_sets(e):
    left = src(U).filter(U["id"].le(2)).select(U["id"])
    right = src(U).filter(U["id"].is_in([2, 3])).select(U["id"])
    assert sorted(got(e, left.union(right))) == [(1,), (2,), (3,)]
    assert sorted(got(e, left.union_all(right))) == [(1,), (2,), (2,), (3,)]
    assert got(e, left.intersect(right)) == [(2,)]
    assert got(e, left.except_(right)) == [(1,)]
    assert sorted(got(e, left.union_all(right).distinct())) == [(1,), (2,), (3,)]
    with pytest.raises(ExactError, match="PIPELINE-TYPE-003"):
        e.execute(left.union(src(U).select(U["score"])))


def test_sort(e):
    order = got(e, src(FLOATS).order_by(FLOATS["value"]).select(FLOATS["id"]))
    assert [x for (x,) in order] == [3, 2, 1, 4, 0]
    assert [x for (x,) in got(e, src(FLOATS).order_by_desc(FLOATS["value"]).select(FLOATS["id"]))] == [0, 4, 1, 2, 3]
    assert got(e, src(NULLS).order_by(NULLS["value"]).select(NULLS["value"])) == [(None,), (1,), (2,)]
    assert [i for (i,) in got(e, src(OPT).order_by(OPT["name"]).select(OPT["id"]))] == [3, 2, 1]  # missing, null, value
    # the last key is the first one; a filter between keeps the order
    chain = src(U).order_by_desc(U["id"]).filter(U["id"].gt(0)).order_by(U["score"]).select(U["id"])
    assert [i for (i,) in got(e, chain)] == [4, 1, 3, 2]


def test_nan_is_equal_to_nothing(e):
    v = FLOATS["value"]
    assert len(got(e, src(FLOATS).select(v).union_all(src(FLOATS).select(v)).distinct())) == 5  # two NaN, one zero, two infinities
    assert len(got(e, src(FLOATS).select(v).intersect(src(FLOATS).select(v)))) == 3
    assert len(got(e, src(FLOATS).select(v).except_(src(FLOATS).select(v)))) == 1
    nan = lit(float("nan"), t.F64)
    for make, want in ((v.eq, 0), (v.ne, 5), (v.lt, 0), (v.is_distinct_from, 5)):
        assert len(got(e, src(FLOATS).filter(make(nan)))) == want


def test_aggregates(e):
    v = TINY["value"]
    assert got(e, src(TINY).aggregate((p.count(), p.sum_(v), p.min_(v), p.max_(v)))) == [(3, 120, -120, 120)]
    assert e.execute(src(TINY).aggregate(p.sum_(v))).dtypes == [("value", "tinyint")]
    assert got(e, src(TINY).filter(v.gt(126)).aggregate((p.count(), p.sum_(v)))) == [(0, None)]
    assert got(e, src(TINY).filter(v.gt(126)).aggregate_by(TINY["group"], p.count())) == []
    n = NULLS["value"]
    assert got(e, src(NULLS).aggregate((p.count_present(n), p.sum_present(n)))) == [(2, 3)]
    assert sorted(got(e, src(NULLS).aggregate_by(n, p.count())), key=str) == [(1, 1), (2, 1), (None, 1)]
    for bad, code in ((lambda: p.sum_(n), "AGG-006"), (lambda: p.sum_(FLOATS["value"]), "AGG-004"), (lambda: p.min_(FLOATS["value"]), "AGG-005")):
        with pytest.raises(ExactError, match=f"PIPELINE-{code}"):
            src(NULLS).aggregate(bad())
    with pytest.raises(ExactError, match="PIPELINE-GROUP-001"):
        e.execute(src(FLOATS).aggregate_by(FLOATS["value"], p.count()))


def test_windows(e):
    by = lambda w: {r[0]: r[3] for r in got(e, src(U).window(w))}
    org, score = U["organization_id"], U["score"]
    assert by(p.rank().partition_by(org).order_by_desc(score)) == {1: 3, 2: 1, 3: 1, 4: 1}
    assert by(p.dense_rank().partition_by(org).order_by_desc(score)) == {1: 2, 2: 1, 3: 1, 4: 1}
    assert by(p.row_number().order_by(score).order_by(U["id"])) == {1: 2, 2: 3, 3: 4, 4: 1}
    run = p.window_sum(score).partition_by(org).order_by(U["id"])
    assert by(run.frame(Rows.to_current())) == {1: 10, 2: 30, 3: 50, 4: 5}
    assert by(run.frame(Rows(2, 3))) == {1: 20, 2: None, 3: None, 4: None}
    bad = [
        (p.row_number().order_by(score), "017"), (p.rank(), "005"), (p.rank().order_by(score).frame(Rows.all()), "006"), (p.window_sum(score), "011"),
        (p.window_sum(score).frame(Rows.to_current()), "012"), (run.frame(Rows(1, 0)), "013"),
    ]
    for w, code in bad:
        with pytest.raises(ExactError, match=f"PIPELINE-WINDOW-{code}"):
            e.execute(src(U).window(w))
    with pytest.raises(ExactError, match="PIPELINE-WINDOW-008"):
        e.execute(src(NULLS).window(p.window_sum(NULLS["value"]).frame(Rows.all())))
    with pytest.raises(ExactError, match="PIPELINE-WINDOW-018"):
        e.execute(src(U).union_all(src(U)).window(p.row_number().order_by(U["id"])))
    with pytest.raises(ExactError, match="PIPELINE-WINDOW-009"):
        e.execute(src(FLOATS).window(p.window_sum(FLOATS["value"]).frame(Rows.all())))
    with pytest.raises(ExactError, match="PIPELINE-WINDOW-003"):
        e.execute(src(FLOATS).window(p.rank().order_by(FLOATS["value"])))


def test_exists(e):
    big = src(O).filter(O["user_id"].eq(U["id"]) & O["total"].gt(100))
    assert sorted(got(e, src(U).filter(big.exists()).select(U["id"]))) == [(1,), (2,)]
    assert sorted(got(e, src(U).filter(big.not_exists()).select(U["id"]))) == [(3,), (4,)]
    with pytest.raises(ExactError, match="EXPR-EXISTS-001"):
        e.execute(src(U).select(big.exists()))


def test_unnest(e):
    assert sorted(got(e, src(OPT).select(OPT["tags"]).unnest())) == [("x",), ("y",), ("z",)]
    with pytest.raises(ExactError, match="PIPELINE-UNNEST-001"):
        e.execute(src(OPT).select(OPT["id"]).unnest())


def test_slices(e):
    ids = src(U).order_by(U["id"]).select(U["id"])
    assert got(e, ids.limit(3).offset(1)) == [(2,), (3,)]
    assert got(e, ids.offset(1).limit(2).limit(1)) == [(2,)]
    with pytest.raises(ExactError, match="PIPELINE-LIMIT-001"):
        ids.limit(2**31)


def test_presence(e):
    n = OPT["name"]
    ids = lambda c: sorted(i for (i,) in got(e, src(OPT).filter(c).select(OPT["id"])))
    assert (ids(n.is_missing()), ids(n.is_null()), ids(n.is_present())) == ([3], [2], [1, 2])
    assert ids(n.is_not_distinct_from(null(t.STRING))) == [2]
    assert sorted(got(e, src(OPT).select(n.coalesce(lit("?", t.STRING))))) == [("?",), ("?",), ("a",)]
    with pytest.raises(Exception, match="RUNTIME-002"):
        e.collect(src(OPT).select(n))
    # an absent side of a join has null fields, not missing ones
    pair = src(U).left_join(src(OPT), U["id"].eq(OPT["id"]))
    assert sorted(i for (i,) in got(e, pair.filter(n.is_missing()).select(U["id"]))) == [3]
    assert sorted(i for (i,) in got(e, pair.filter(n.is_null()).select(U["id"]))) == [2, 4]


def test_truth_is_a_value(e):
    v = NULLS["value"]
    unknown = v.gt(1)
    rows = dict(got(e, src(NULLS).select((NULLS["id"], unknown.eq(v.lt(0))))))
    assert rows == {1: False, 2: True, 3: True}
    assert {r[0] for r in got(e, src(NULLS).select(unknown.is_null()))} == {False}
    assert dict(got(e, src(NULLS).select((NULLS["id"], unknown.if_else(lit(1, t.I64), lit(0, t.I64)))))) == {1: 1, 2: 0, 3: 0}


def test_parameters(e):
    q = src(U).filter(U["score"].gt(parameter("least", t.I64))).select(U["id"])
    assert sorted(got(e, q, least=15)) == [(2,), (3,)]
    with pytest.raises(ExactError, match="EXPR-EVAL-103"):
        e.execute(q)
    with pytest.raises(ExactError, match="EXPR-EVAL-111"):
        e.execute(q, least="x")
    with pytest.raises(ExactError, match="EXPR-PARAM-003"):
        e.execute(q.filter(lit("a", t.STRING).eq(parameter("least", t.STRING))), least=1)
    for name, code in (("", "001"), ("x" * 300, "002")):
        with pytest.raises(ExactError, match=f"EXPR-PARAM-{code}"):
            parameter(name, t.I64)


def test_limits_and_streams(e):
    e.limits = Limits(rows=8)
    with pytest.raises(ExactError, match="ENGINE-LIMIT-004"):
        e.collect(src(U).cross_join(src(O)))
    assert [len(b) for b in e.stream(src(U), batch_rows=3)] == [3, 1]
    with pytest.raises(ExactError, match="ENGINE-LIMIT-003"):
        Limits(concurrency=0)
    steps = e.explain(src(U).filter(U["id"].gt(1)).select(U["id"]))
    assert [s["operation"] for s in steps] == ["source", "filter", "project", "plan"]


def test_long_chains(e):
    q = src(U)
    for _ in range(300):
        q = q.limit(3)
    assert len(fingerprint(q)) == 64
    small = src(U)
    for _ in range(12):
        small = small.limit(3)
    assert len(got(e, small)) == 3


def test_fingerprints():
    a, b = src(U).select(U["id"]), src(U).select(U["score"])
    assert fingerprint(src(U).filter(U["id"].is_in([1, 2]))) == fingerprint(src(U).filter(U["id"].is_in([2, 1])))
    assert fingerprint(a.union(b)) == fingerprint(b.union(a))
    assert fingerprint(a.except_(b)) != fingerprint(b.except_(a))
    assert fingerprint(Pipeline.from_model_as(U, "x")) == fingerprint(src(U))
    assert fingerprint(a) != fingerprint(a.limit(1))
    assert fingerprint(a.distinct()) == fingerprint(a.distinct().distinct())
    assert fingerprint(a.offset(0)) == fingerprint(a)


# --- writes ---
ACCOUNT = (
    ModelBuilder("t/account").field("id", t.U64).field("email", t.STRING).field("active", t.BOOL).field("balance", t.I64).field("reserve", t.I64)
    .optional_field("nick", t.STRING.nullable()).identity("id").unique("email").freeze()
)
PARENT = ModelBuilder("t/parent").field("id", t.U64).identity("id").freeze()
CHILD = ModelBuilder("t/child").field("id", t.U64).field("parent_id", t.U64.nullable()).identity("id").reference("t/parent", ("parent_id",), ("id",)).freeze()
A = ACCOUNT


def account(i, **kw):
    return {"id": i, "email": f"{i}@x", "active": True, "balance": 10 * i, "reserve": i} | kw


@pytest.fixture()
def bank(spark):
    e = Engine(spark)
    e.load(ACCOUNT, [account(1), account(2, active=False), account(3, nick=None)])
    return e


def test_update_is_simultaneous(bank):
    bank.apply(update(A).set(A["balance"], A["reserve"]).set(A["reserve"], A["balance"]).filter(A["active"].is_true()))
    rows = {int(r.id): (r.balance, r.reserve) for r in bank.rows(A)}
    assert rows == {1: (1, 10), 2: (20, 2), 3: (3, 30)}
    with pytest.raises(ExactError, match="WRITE-UPDATE-002"):
        update(A).set(A["balance"], 1).set(A["balance"], 2)
    with pytest.raises(ExactError, match="WRITE-UPDATE-001"):
        update(A).all()
    with pytest.raises(ExactError, match="WRITE-UPDATE-003"):
        update(A).set(U["score"], 1)
    with pytest.raises(ExactError, match="WRITE-UPDATE-005"):
        update(A).set(A["balance"], A["email"])
    with pytest.raises(ExactError, match="MEMORY-WRITE-003"):
        delete(A).filter(Pipeline.from_model(A).exists())
    with pytest.raises(ExactError, match="WRITE-SCOPE-002"):
        bank.apply(update(A).set(A["balance"], 1))


def test_writes_are_atomic(bank):
    with pytest.raises(ExactError, match="DATASET-IDENTITY-001"):
        bank.apply(insert_many(A, [account(7), account(1, email="other")]).batch_rows(1))
    with pytest.raises(ExactError, match="DATASET-UNIQUE-001"):
        bank.apply(update(A).set(A["email"], "same").all())
    assert len(bank.rows(A)) == 3
    bank.apply(delete(A).filter(A["balance"].gt(15)))
    assert [int(r.id) for r in bank.rows(A)] == [1]
    with pytest.raises(ExactError, match="WRITE-BATCH-001"):
        insert(A, account(9)).batch_rows(0)
    with pytest.raises(ExactError, match="RUNTIME-001"):
        bank.apply(insert(A, account(9, zzz=1)))


def test_references_and_transactions(spark):
    e = Engine(spark)
    e.load(PARENT, [{"id": 1}])
    e.load(CHILD, [{"id": 1, "parent_id": 1}, {"id": 2, "parent_id": None}])
    with pytest.raises(ExactError, match="MEMORY-REFERENCE-002"):
        e.apply(insert(CHILD, {"id": 3, "parent_id": 999}))
    tx = e.begin()
    tx.apply(insert(CHILD, {"id": 3, "parent_id": 5}))  # fine until commit
    tx.apply(insert(PARENT, {"id": 5}))
    tx.commit()
    assert len(e.rows(CHILD)) == 3
    tx = e.begin()
    tx.apply(delete(PARENT).all())
    with pytest.raises(ExactError, match="MEMORY-REFERENCE-002"):
        tx.commit()
    tx.rollback()
    assert len(e.rows(PARENT)) == 2
    with pytest.raises(ExactError, match="MEMORY-TX-001"):
        e.begin("snapshot")
    with pytest.raises(ExactError, match="MEMORY-TX-002"):
        t2 = e.begin(max_writes=1)
        t2.apply(insert(PARENT, {"id": 6}))
        t2.apply(insert(PARENT, {"id": 7}))


def test_registry(spark, e):
    with pytest.raises(ExactError, match="MEMORY-STORE-001"):
        e.load(USER, [])
    with pytest.raises(ExactError, match="MEMORY-STORE-003"):
        e.table(PARENT)
    other = ModelBuilder("t/user").field("id", t.U64).freeze()
    with pytest.raises(ExactError, match="MEMORY-STORE-002"):
        e.register(other)
    with pytest.raises(ExactError, match="MEMORY-STORE-004"):
        e.table(other)
    e.clear()
    e.register(USER)
    assert e.rows(USER) == []


# --- functions ---
F = (
    ModelBuilder("t/f").field("text", t.STRING).field("date", t.DATE).field("local", t.LOCAL).field("instant", t.INSTANT).field("duration", t.DURATION)
    .field("u8", t.U8).field("i16", t.I16).field("f", t.F64).field("m", t.map_of(t.STRING, t.I32)).freeze()
)
ROW = dict(
    text="  HéLLo 🦀  ", date=dt.date(2026, 8, 29), local=dt.datetime(2026, 8, 29, 13, 45, 30, 123456), instant=dt.datetime.fromtimestamp(1_700_000_000, dt.UTC),
    duration=3_661_000_000_000, u8=12, i16=-7, f=1.0, m={"a": 1, "b": 2},
)


def test_functions(spark):
    x = F["text"]
    cases = [
        (x.trim().to_lowercase(), "héllo 🦀"), (x.len(), 15), (x.trim().scalar_len(), 7), (x.trim_start().ends_with("  "), True), (x.trim_end().starts_with("  "), True),
        (x.contains("LL"), True), (x.is_empty(), False), (x.trim().to_uppercase(), "HÉLLO 🦀"), (lit("  a　", t.STRING).trim(), "a"),
        (F["date"].year(), 2026), (F["date"].month(), 8), (F["date"].day(), 29), (F["date"].ordinal(), 241), (F["date"].weekday(), 6),
        (F["local"].date(), dt.date(2026, 8, 29)), (F["local"].time(), 49_530_123_456_000), (F["instant"].unix_timestamp(), 1_700_000_000), (F["duration"].whole_seconds(), 3661),
        (F["u8"].cast(t.U16), 12), (F["u8"].cast(t.I16), 12), (F["i16"] / 2, -3), (F["i16"] % 3, -1), (F["i16"].abs(), 7), (-F["i16"], 7),
        (F["u8"] - 5, 7), (F["f"] / 0.0, float("inf")), (-F["f"] / 0.0, float("-inf")), (F["f"] / -0.0, float("-inf")),
        (F["m"].eq(lit({"b": 2, "a": 1}, t.map_of(t.STRING, t.I32))), True), (F["u8"].is_in([]), False), (F["u8"].not_in([]), True),
        (F["u8"].between(1, 12), True), (F["u8"].not_between(1, 12), False),
    ]
    e = Engine(spark)
    e.bind(F, e._rows(F, [ROW]))
    found = e.execute(Pipeline.from_model(F).select({f"c{k:02}": c for k, (c, _) in enumerate(cases)})).first()
    for k, (_, want) in enumerate(cases):
        assert found[k] == want, k


def test_overflow_raises(spark):
    for bad in (F["u8"] - 13, F["u8"] * 22, F["i16"] * 32767, F["u8"] / 0, F["i16"] % 0):
        with pytest.raises(Exception, match="OVERFLOW|overflow|DIVIDE|BY_ZERO|EXPR-EVAL-002"):
            evaluate(bad, F, ROW, spark)
    with pytest.raises(ExactError, match="EXPR-EVAL-002"):
        lit(127, t.I8) + lit(1, t.I8)  # literals are folded while planning


def test_rejected_expressions():
    f = F
    for bad, code in (
        (lambda: f["u8"].cast(t.I8), "EXPR-CAST-003"), (lambda: f["u8"].cast(t.U16.nullable()), "EXPR-CAST-001"), (lambda: f["text"].cast(t.U8), "EXPR-CAST-002"),
        (lambda: f["u8"].eq(f["i16"]), "EXPR-TYPE-006"), (lambda: f["text"] + "x", "EXPR-TYPE-005"), (lambda: f["f"] % 2.0, "EXPR-TYPE-011"),
        (lambda: f["u8"].len(), "EXPR-TYPE-007"), (lambda: f["text"].year(), "EXPR-FUNCTION-002"), (lambda: -f["u8"], "EXPR-TYPE-013"),
        (lambda: f["m"].lt(f["m"]), "EXPR-TYPE-004"), (lambda: lit(300, t.U8), "EXPR-LITERAL-001"), (lambda: f["u8"].nullable().nullable(), "EXPR-TYPE-015"),
        (lambda: null(t.U8).coalesce(f["text"]), "EXPR-TYPE-014"),
    ):
        with pytest.raises(ExactError, match=code):
            bad()


def test_missing_is_not_none():
    assert MISSING is not None and not MISSING


MONEY_MODEL = ModelBuilder("t/money").field("id", t.U64).field("a", t.decimal(18, 2)).field("b", t.decimal(12, 3)).identity("id").freeze()


def test_decimal_division_has_18_true_digits(spark):
    """Against Python's Decimal, rounded half away from zero."""
    rng = random.Random(11)
    rows = [(Decimal(rng.randrange(-(10**rng.randint(1, 18)), 10**18)) / 100, Decimal(rng.randrange(1, 10 ** rng.randint(1, 12)) * rng.choice((1, -1))) / 10**3) for _ in range(400)]
    rows += [(Decimal("1.00"), Decimal("3.000")), (Decimal("-2.00"), Decimal("3.000")), (Decimal(0), Decimal("-7.000")), (Decimal("9999999999999999.99"), Decimal("0.001"))]
    m, e = MONEY_MODEL, Engine(spark)
    with localcontext() as c:
        c.prec = 60
        fits = [(a, b) for a, b in rows if abs(a / b) < 10**19]
        e.load(m, [dict(id=k, a=a, b=b) for k, (a, b) in enumerate(fits)])
        got = {r.id: r for r in e.collect(Pipeline.from_model(m).select({"id": m["id"], "q": m["a"] / m["b"]}))}
        for k, (a, b) in enumerate(fits):
            assert got[k].q == (a / b).quantize(Decimal(1).scaleb(-18), rounding=ROUND_HALF_UP), (a, b)
    e = Engine(spark)
    e.load(m, [dict(id=1, a=Decimal(1), b=Decimal(0))])
    with pytest.raises(Exception, match="EXPR-EVAL-003"):
        e.collect(Pipeline.from_model(m).select(m["a"] / m["b"]))
    with pytest.raises(ExactError, match="EXPR-EVAL-003"):
        lit(Decimal(1), t.decimal(38, 2)) / lit(Decimal(3), t.decimal(5, 2))


def test_overflow_carries_its_code(spark):
    m = ModelBuilder("t/ints").field("id", t.U64).field("a", t.I8).field("b", t.I32).field("c", t.I64).identity("id").freeze()
    e = Engine(spark)
    e.load(m, [dict(id=1, a=-128, b=2**31 - 1, c=-(2**63)), dict(id=2, a=-128, b=1, c=-1)])
    one = lambda x: Pipeline.from_model(m).filter(m["id"].eq(1)).select(x)
    for x in (m["a"] - 1, -m["a"], m["a"].abs(), m["a"] / -1, m["b"] + 1, m["b"] * m["b"], m["c"] - 1, m["c"] * 2, m["c"] / -1, -m["c"], m["c"] / (m["c"] - m["c"]), m["b"] % (m["b"] - m["b"])):
        with pytest.raises(Exception, match="EXPR-EVAL-002"):
            e.collect(one(x))
    for total in (p.sum_(m["a"]), p.sum_(m["b"]), p.sum_(m["c"])):
        with pytest.raises(Exception, match="EXPR-EVAL-002"):
            e.collect(Pipeline.from_model(m).aggregate(total))
    assert e.collect(one((m["a"] + 1, m["c"] + 1, m["c"] % 10)))[0] == (-127, -(2**63) + 1, -8)


def test_one_engine_keeps_plans_apart(e):
    """Aliases and the order of inputs change rows and names, though not what a fingerprint says."""
    pair = lambda a, b: Pipeline.from_model_as(U, a).cross_join(Pipeline.from_model_as(U, b))
    assert fingerprint(pair("a", "b")) == fingerprint(pair("x", "y"))
    assert e.execute(pair("a", "b")).columns[0] == "a.id" and e.execute(pair("x", "y")).columns[0] == "x.id"
    left, right = (Pipeline.from_model(U).filter(U["id"].eq(k)).select(U["id"]) for k in (1, 4))
    assert [r[0] for r in e.collect(left.union_all(right))] == [1, 4] and [r[0] for r in e.collect(right.union_all(left))] == [4, 1]
    assert e.execute(left.union_all(right)) is e.execute(left.union_all(right))  # equal plans are still found
    f, g = (SemanticFunction("t/f", 1, (t.I64,), t.I64, build) for build in (lambda c: c + 1, lambda c: c + 2))
    got = [e.collect(Pipeline.from_model(U).filter(U["id"].eq(1)).select(call(x, U["score"])))[0][0] for x in (f, g)]
    assert got == [11, 12]


def test_cache_bounds(spark, e):
    for bad, code in (({"entries": 0}, "001"), ({"bytes": 0}, "001"), ({"bytes": 10, "entry_bytes": 11}, "002")):
        with pytest.raises(ExactError, match=f"ENGINE-CACHE-{code}"):
            CachePolicy(**bad)
    small = Engine(spark, cache=CachePolicy(entries=2))
    small.bind(U, e.table(U))
    plans = [Pipeline.from_model(U).filter(U["id"].eq(k)) for k in range(4)]
    for x in plans:
        small.execute(x)
    assert len(small._plans) == 2 and small.execute(plans[3]) is small.execute(plans[3])
    none = Engine(spark, cache=CachePolicy(bytes=20, entry_bytes=10))  # no plan is as small
    none.bind(U, e.table(U))
    assert len(none.collect(plans[1])) == 1 and not none._plans


def test_filters_pass_sorts(spark, e, tmp_path):
    e.table(O).write.parquet(str(tmp_path / "o"))
    disk = Engine(spark)
    disk.bind(O, spark.read.parquet(str(tmp_path / "o")))
    total = lambda x: Pipeline.from_model(O).order_by(O["id"]).order_by_desc(O["total"]).filter(O["total"].gt(x)).select({"id": O["id"], "total": O["total"]})
    assert [r.total for r in disk.collect(total(100))] == [500, 200, 150]
    assert "GreaterThan(total,100)" in disk.execute(total(100))._jdf.queryExecution().executedPlan().toString()
    sliced = Pipeline.from_model(O).order_by_desc(O["total"]).limit(2)
    assert [r.total for r in disk.collect(sliced.order_by(O["total"]))] == [200, 500]
    assert [r.total for r in disk.collect(sliced.filter(O["total"].lt(300)))] == [200]
    assert len(disk.collect(Pipeline.from_model(O).order_by(O["total"]).aggregate(p.count()))) == 1


def test_transaction_bounds(spark):
    e = Engine(spark)
    e.load(PARENT, [{"id": 1}, {"id": 2}])
    tx = e.begin(max_rows=3)
    tx.apply(insert(PARENT, {"id": 3}))
    with pytest.raises(ExactError, match="MEMORY-TX-003"):
        tx.apply(insert(PARENT, {"id": 4}))
    tx.commit()
    assert len(e.rows(PARENT)) == 3
    with pytest.raises(ExactError, match="MEMORY-TX-004"):
        e.begin(max_bytes=10).apply(insert(PARENT, {"id": 5}))


def test_many_writes_cut_the_plan(spark, tmp_path, monkeypatch):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    monkeypatch.setattr("exactframe.session.CUT_AFTER", 3)
    e = Engine(spark)
    e.load(PARENT, [{"id": 0}])
    for k in range(1, 7):
        e.apply(insert(PARENT, {"id": k}))
    assert sorted(r.id for r in e.rows(PARENT)) == list(range(7))
    assert e.table(PARENT)._jdf.queryExecution().analyzed().toString().count("Union") == 0
