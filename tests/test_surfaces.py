"""Definitions, sources, wire form, migration, inference, placement."""

import datetime as dt
import json
import random
from decimal import Decimal

import pytest

from exactframe import migrate as m
from exactframe import types as t
from exactframe.errors import ExactError
from exactframe.expr import lit
from exactframe.functions import SemanticFunction
from exactframe.model import ModelBuilder, ModelSet
from exactframe.operators import inference, placement
from exactframe.operators.features import FeatureLimits, FeatureSet
from exactframe.operators.vector import approximate_search, exact_search
from exactframe.plans.pipeline import Pipeline
from exactframe.sources import documents, wire
from exactframe.sources.jsonl import JsonlEngine, JsonlLimits
from exactframe.sources.sql import ColumnMapping, SqlCatalog, TableMapping, quoted
from exactframe.values import MISSING, check


def code(f, want):
    with pytest.raises(ExactError) as e:
        f()
    assert e.value.code == want, e.value


def B(key="t/m"):
    return ModelBuilder(key).field("a", t.U64).field("b", t.STRING)


def test_model_definitions():
    code(lambda: B().field("a", t.U8).freeze(), "FIELD-003")
    code(lambda: B().field("c", t.U8, "a").freeze(), "FIELD-004")
    code(lambda: B().field("", t.U8).freeze(), "FIELD-001")
    code(lambda: ModelBuilder("").freeze(), "MODEL-001")
    code(lambda: B().identity("z").freeze(), "CONSTRAINT-003")
    code(lambda: B().identity().freeze(), "CONSTRAINT-001")
    code(lambda: B().identity("a").identity("a"), "CONSTRAINT-008")
    code(lambda: B().identity("a", "a").freeze(), "CONSTRAINT-005")
    code(lambda: B().optional_field("o", t.U8).identity("o").freeze(), "CONSTRAINT-002")
    code(lambda: B().field("f", t.F64).identity("f").freeze(), "CONSTRAINT-006")
    code(lambda: B().field("f", t.F64).unique("f").freeze(), "CONSTRAINT-007")
    code(lambda: B().reference("x", ("a",), ()).freeze(), "CONSTRAINT-004")
    code(lambda: B().reference("x", ("a", "b"), ("c", "c")).freeze(), "CONSTRAINT-009")
    code(lambda: B().relation("r", "x", "one", ()).freeze(), "RELATION-001")
    code(lambda: B().relation("r", "x", "one", (("z", "a"),)).freeze(), "RELATION-002")
    code(lambda: B().relation("r", "x", "one", (("a", "a"),)).relation("r", "x", "one", (("a", "a"),)).freeze(), "RELATION-005")
    code(lambda: B().relation("r", "x", "one", (("a", "a"), ("a", "b"))).freeze(), "RELATION-007")
    one = B().freeze()
    code(lambda: one.field("zz"), "RUNTIME-101")
    code(lambda: one.get("a", t.U8), "RUNTIME-102")
    assert one.get("a", t.U64).op == "field"


def test_model_sets():
    target = ModelBuilder("t/x").field("id", t.U64).field("n", t.U64).identity("id").freeze()
    code(lambda: ModelSet(target, target), "MODELSET-001")
    code(lambda: ModelSet(B().reference("t/x", ("a",), ("id",)).freeze()), "CONSTRAINT-101")
    code(lambda: ModelSet(target, B().reference("t/x", ("a",), ("zz",)).freeze()), "CONSTRAINT-103")
    code(lambda: ModelSet(target, B().reference("t/x", ("b",), ("id",)).freeze()), "CONSTRAINT-104")
    code(lambda: ModelSet(target, B().reference("t/x", ("a",), ("n",)).freeze()), "CONSTRAINT-105")
    code(lambda: ModelSet(B().relation("r", "t/x", "one", (("a", "id"),)).freeze()), "RELATION-101")
    code(lambda: ModelSet(target, B().relation("r", "t/x", "one", (("a", "n"),)).freeze()), "RELATION-105")
    code(lambda: ModelSet(target, B().relation("r", "t/x", "many", (("b", "n"),)).freeze()), "RELATION-104")
    assert len(list(ModelSet(target, B().reference("t/x", ("a",), ("id",)).freeze()))) == 2


def test_types_and_values():
    code(lambda: t.map_of(t.F64, t.U8).validate(), "TYPE-009")
    code(lambda: t.Type("i7").validate(), "TYPE-008")
    code(lambda: t.semantic(t.U8, "nospace", 1), "TYPE-013")
    code(lambda: t.semantic(t.U8, "a/b", 0), "TYPE-007")
    deep = t.U8
    for _ in range(80):
        deep = t.list_of(deep)
    code(deep.validate, "TYPE-001")
    mine, other = t.semantic(t.U8, "my/u", without=("ordering",)), t.semantic(t.U16, "my/u")
    assert not mine.has("ordering") and mine.has("equality")
    code(lambda: t.consistent([mine, other]), "TYPE-101")
    code(lambda: ModelBuilder("t/k").field("x", mine).freeze()["x"].lt(3), "EXPR-TYPE-004")
    assert not t.F64.has("keyable") and t.F64.has("ordering") and not t.TRUTH.has("ordering")
    assert t.tuple_of(t.U8, t.STRING).has("keyable") and not t.list_of(t.U8).has("keyable")
    for v, ty, c in (
        (MISSING, t.U8, "RUNTIME-002"), (None, t.U8, "RUNTIME-003"), (300, t.U8, "RUNTIME-004"), ("ab", t.CHAR, "RUNTIME-004"), (10**38, t.I128, "RUNTIME-004"),
        ({"x": 1}, t.record_of(y=t.U8), "RUNTIME-005"), ([MISSING], t.list_of(t.U8), "RUNTIME-006"), ([(1, 2), (1, 3)], t.map_of(t.U8, t.U8), "RUNTIME-007"),
    ):
        code(lambda v=v, ty=ty: check(v, ty), c)
    assert check(Decimal("1.50"), t.decimal(5, 2)) == Decimal("1.50")


def test_functions_registry():
    make = lambda **k: SemanticFunction(**({"key": "o/f", "version": 1, "takes": (t.I32,), "gives": t.I32, "build": lambda c: c} | k))
    for bad, c in (({"key": "f"}, "EXPR-FUNC-001"), ({"version": 0}, "EXPR-FUNC-002"), ({"depends": (("", 1),)}, "EXPR-FUNC-003"), ({"key": "core/f"}, "EXPR-FUNC-005"), ({"deterministic": False}, "EXPR-FUNC-006"), ({"takes": ()}, "EXPR-FUNCTION-001")):
        code(lambda bad=bad: make(**bad), c)


def test_conflicting_functions(spark):
    from exactframe.expr import call
    from exactframe.session import Engine

    model = ModelBuilder("t/c").field("x", t.I32).freeze()
    f = SemanticFunction("o/f", 1, (t.I32,), t.I32, lambda c: c + 1)
    g = SemanticFunction("o/f", 1, (t.I32,), t.I64, lambda c: c)
    e = Engine(spark)
    e.load(model, [{"x": 1}])
    assert e.collect(Pipeline.from_model(model).select(call(f, model["x"])))[0][0] == 2
    code(lambda: e.execute(Pipeline.from_model(model).select((call(f, model["x"]), call(g, model["x"])))), "EXPR-FUNC-004")


EVENT = (
    ModelBuilder("t/event").field("id", t.U64).field("active", t.BOOL).field("score", t.I64).field("tags", t.list_of(t.STRING)).optional_field("nickname", t.STRING.nullable()).identity("id").freeze()
)


def lines(tmp_path, *objs):
    (tmp_path / "e.jsonl").write_text("".join((o if isinstance(o, str) else json.dumps(o)) + "\n" for o in objs))


def test_jsonl(spark, tmp_path):
    rows = [dict(id=k, active=k > 1, score=10 * k, tags=["a"] * k, **({"nickname": n} if n != "-" else {})) for k, n in ((1, "one"), (2, None), (3, "-"))]
    lines(tmp_path, *rows)
    e = JsonlEngine(spark, str(tmp_path))
    e.bind(EVENT, "e.jsonl")
    src = Pipeline.from_model(EVENT)
    q = src.filter(EVENT["active"].is_true() & EVENT["score"].gt(15)).slice(0, 1).select((EVENT["id"], EVENT["score"]))
    assert [tuple(map(int, r)) for r in e.execute(q).collect()] == [(2, 20)]
    ids = lambda c: [int(r[0]) for r in e.execute(src.filter(c).select(EVENT["id"])).collect()]
    assert (ids(EVENT["nickname"].is_missing()), ids(EVENT["nickname"].is_null())) == ([3], [2])
    code(lambda: e.execute(src.distinct()), "ENGINE-PLACEMENT-001")
    code(lambda: e.bind(EVENT, "e.jsonl"), "JSONL-SOURCE-004")
    code(lambda: JsonlEngine(spark, "/nonexistent"), "JSONL-SOURCE-001")
    (tmp_path / "sub").mkdir()
    f = JsonlEngine(spark, str(tmp_path / "sub"))
    code(lambda: f.bind(EVENT, "../e.jsonl"), "JSONL-SOURCE-002")
    (tmp_path / "sub" / "link").symlink_to(tmp_path / "e.jsonl")
    code(lambda: f.bind(EVENT, "link"), "JSONL-SOURCE-002")
    code(lambda: f.bind(EVENT, "none"), "JSONL-SOURCE-005")
    code(lambda: f.table(EVENT), "JSONL-SOURCE-006")
    g = JsonlEngine(spark, str(tmp_path), JsonlLimits(source_bytes=10))
    g.bind(EVENT, "e.jsonl")
    code(lambda: g.table(EVENT), "JSONL-LIMIT-001")
    code(lambda: JsonlLimits(rows=0), "JSONL-LIMIT-000")
    h = JsonlEngine(spark, str(tmp_path), JsonlLimits(rows=1))
    h.bind(EVENT, "e.jsonl")
    with pytest.raises(Exception, match="JSONL-LIMIT-003"):
        h.execute(src).collect()


def test_jsonl_rejects():
    from exactframe.sources.jsonl import decode_line

    good = '"active":true,"score":1,"tags":[]'
    for line, want in (
        ("", "JSONL-DECODE-001"), ("{", "JSONL-DECODE-001"), ("[]", "JSONL-DECODE-002"), ('{"id":1,"id":2}', "JSONL-DECODE-001"), (f'{{"id":1,{good},"zz":1}}', "JSONL-DECODE-003"),
        (f'{{"id":"x",{good}}}', "JSONL-DECODE-005"), (f'{{"id":-1,{good}}}', "JSONL-DECODE-004"), ('{"id":1}', "JSONL-DECODE-004"), (f'{{"id":true,{good}}}', "JSONL-DECODE-005"),
    ):
        code(lambda line=line: decode_line(line, EVENT, JsonlLimits()), want)
    code(lambda: decode_line("x" * 99, EVENT, JsonlLimits(line_bytes=9)), "JSONL-LIMIT-002")
    nested = ModelBuilder("t/n").field("x", t.list_of(t.list_of(t.U8))).freeze()
    code(lambda: decode_line('{"x":[[1]]}', nested, JsonlLimits(depth=2)), "JSONL-LIMIT-004")
    wide = (
        ModelBuilder("t/w").field("f32", t.F32).field("f64", t.F64).field("d", t.decimal(6, 2)).field("b", t.BYTES).field("date", t.DATE).field("time", t.TIME).field("at", t.INSTANT)
        .field("dur", t.DURATION).field("m", t.map_of(t.U8, t.STRING)).field("t", t.tuple_of(t.U8, t.STRING)).field("big", t.U128).field("local", t.LOCAL).freeze()
    )
    text = '{"f32":"NaN","f64":1.5,"d":"12.30","b":"hex:00ff","date":"2024-02-29","time":"01:02:03.5","at":"2024-01-01T00:00:00Z","dur":"-5","m":[[1,"a"]],"t":[1,"x"],"big":"12345678901234567890123","local":"2024-01-01T10:00:00"}'
    got = decode_line(text, wide, JsonlLimits())
    assert got[1:7] == (1.5, Decimal("12.30"), b"\0\xff", dt.date(2024, 2, 29), 3_723_500_000_000, dt.datetime(2024, 1, 1, tzinfo=dt.UTC))
    assert got[7:11] == (-5, {1: "a"}, (1, "x"), 12345678901234567890123)
    code(lambda: decode_line(text.replace('[1,"x"]', "[1]"), wide, JsonlLimits()), "JSONL-DECODE-006")


def test_stateless_stream(spark, tmp_path):
    from exactframe import streaming

    lines(tmp_path, dict(id=1, active=True, score=5, tags=["a", "b"]), dict(id=2, active=False, score=6, tags=[]))
    stream = streaming.stream_lines(spark, str(tmp_path), EVENT)
    q = Pipeline.from_model(EVENT).filter(EVENT["active"].is_true()).select(EVENT["tags"]).unnest()
    run = streaming.execute(stream, EVENT, q).writeStream.format("memory").queryName("tags").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted(r[0] for r in spark.table("tags").collect()) == ["a", "b"]
    code(lambda: streaming.execute(stream, EVENT, q.distinct()), "ENGINE-PLACEMENT-001")


def test_sql_adapter():
    mapping = TableMapping(EVENT, "public", 'ev"t', {k: ColumnMapping(k) for k in ("id", "active", "score", "tags")} | {"nickname": ColumnMapping("nick", "nick_present")})
    c = SqlCatalog(mapping)
    q = Pipeline.from_model(EVENT).filter(EVENT["score"].gt(5) & EVENT["nickname"].is_missing()).select({"id": EVENT["id"]}).slice(2, 3)
    got = c.compile(q)
    assert got.binds == (5,) and got.sql.endswith('FROM "public"."ev""t" WHERE (("score" > $1) AND (NOT "nick_present")) LIMIT 3 OFFSET 2')
    code(lambda: c.compile(q.distinct()), "ENGINE-PLACEMENT-001")
    code(lambda: TableMapping(EVENT, "p", "t", {}), "SQL-MAPPING-001")
    code(lambda: quoted("x" * 64), "SQL-MAPPING-003")
    stages = documents.stages(q)
    assert [next(iter(s)) for s in stages] == ["$match", "$project", "$skip", "$limit"]
    code(lambda: documents.stages(q.distinct()), "ENGINE-PLACEMENT-001")


def test_wire():
    types = [t.list_of(t.STRING.nullable()), t.map_of(t.U8, t.decimal(9, 3)), t.record_of(b=t.F32, a=t.tuple_of(t.I128, t.UUID)), t.semantic(t.U8, "my/u", 3, ("ordering",))]
    for ty in types:
        data = wire.encode_type(ty)
        assert wire.decode_type(data) == ty and data[:4] == wire.MAGIC and len(data) > wire.HEADER
    values = [
        (["a", None], types[0]), ({2: Decimal("1.500"), 1: Decimal("-2")}, types[1]), (dt.datetime(2024, 1, 1, tzinfo=dt.UTC), t.INSTANT), (None, t.U8.nullable()),
        ("0f3e5a2c-0000-4000-8000-000000000001", t.UUID), (b"\0\1", t.BYTES), (1.5, t.F32), (dt.date(1, 1, 1), t.DATE), (-(10**30), t.I128), (True, t.TRUTH),
    ]
    for v, ty in values:
        assert wire.decode_datum(wire.encode_datum(v, ty))[0] == check(v, ty)
    assert wire.encode_datum({1: Decimal(1), 2: Decimal(2)}, types[1]) == wire.encode_datum({2: Decimal(2), 1: Decimal(1)}, types[1])
    assert wire.decode_datum(wire.encode_datum(MISSING, t.U8, True))[0] is MISSING
    assert wire.decode_model(wire.encode_model(EVENT)).same(EVENT)
    assert len(wire.decode_models(wire.encode_models(ModelSet(EVENT, B().freeze()))).models) == 2
    rng = random.Random(7)
    good = wire.encode_model(EVENT)
    for _ in range(300):  # changed frames decode to something or fail cleanly
        bad = bytearray(good)
        for _ in range(rng.randint(1, 4)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        try:
            wire.decode_model(bytes(bad[: rng.randint(1, len(bad))]))
        except ExactError:
            pass
    with pytest.raises(ExactError):
        wire.decode_type(wire.encode_type(types[0]) + b"x")
    with pytest.raises(ExactError):
        wire.decode_type(wire.encode_type(types[0]), wire.WireLimits(depth=0))


def snapshot(rev, *entities):
    return m.Snapshot("s", rev, entities)


def test_migration():
    f = lambda k, n=None, ty="int", req=True: m.CatalogField(k, n or k, ty, req)
    a = snapshot("1", m.Entity("e", "old", (f("a"), f("b"))), m.Entity("gone", "gone"))
    b = snapshot("2", m.Entity("e", "new", (f("a", ty="bigint"), f("c", req=False)), (m.CatalogIndex("i", "i", ("a",)),)), m.Entity("x", "x", (f("k"),)))
    code(lambda: m.diff(a, b), "MIGRATE-DIFF-004")
    intent = ("entity", "", "e", "old", "new")
    plan = m.plan(a, b, (intent,))
    kinds = [s.kind for s in plan.steps]
    assert kinds == ["rename_entity", "create_entity", "add_field", "alter_field", "drop_field", "create_index", "drop_entity"]
    code(lambda: m.diff(a, b, (intent, ("field", "e", "a", "x", "y"))), "MIGRATE-DIFF-005")
    all_ = m.MigrationPolicy(rewrite=True, destructive=True, rebuild=True)
    code(lambda: m.apply(m.TableBackend(a), plan), "MIGRATE-POLICY-002")
    code(lambda: all_.authorize(plan, m.approve(m.plan(b, b))), "MIGRATE-POLICY-001")
    ok = m.approve(plan, *range(len(plan.steps)))
    said = []
    backend = m.TableBackend(a, said.append)
    assert len(m.apply(backend, plan, all_, ok)) == 7 and backend.state.content() == b.content() and said[0].startswith("ALTER TABLE `old` RENAME")
    code(lambda: m.apply(m.TableBackend(snapshot("9")), plan, all_, ok), "MIGRATE-APPLY-STALE")
    code(lambda: m.apply(m.TableBackend(snapshot("1")), plan, all_, ok), "MIGRATE-APPLY-004")
    code(lambda: m.apply(backend, plan, all_, ok, max_steps=1), "MIGRATE-APPLY-002")

    def broken(sql):
        raise RuntimeError("no")

    stuck = m.TableBackend(a, broken)
    code(lambda: m.apply(stuck, plan, all_, ok), "MIGRATE-APPLY-005")
    assert stuck.state == a


def test_inference(spark):
    up = inference.Provider("up", ("text",), lambda xs: ([x.upper() for x in xs], len(xs)), max_batch=2, cost_per_input=1)
    pay = inference.InferenceLimits(max_cost_microunits=10)
    run = lambda p=up, n=1, privacy="public", policy=inference.Policy(), limits=pay, task="text": inference.infer(p, task, [("a", privacy)] * n, policy, limits)
    assert run(n=2) == ["A", "A"]
    from dataclasses import replace

    code(lambda: run(n=0), "ML-INFERENCE-001")
    code(lambda: run(task="embedding"), "ML-INFERENCE-004")
    code(lambda: run(n=3), "ML-INFERENCE-005")
    code(lambda: run(replace(up, max_privacy="public"), privacy="restricted"), "ML-INFERENCE-006")
    code(lambda: run(replace(up, remote=True)), "ML-INFERENCE-006")
    code(lambda: run(replace(up, retains=True)), "ML-INFERENCE-007")
    code(lambda: run(limits=inference.InferenceLimits()), "ML-INFERENCE-008")
    code(lambda: run(replace(up, run=lambda xs: 1 / 0)), "ML-INFERENCE-010")
    code(lambda: run(replace(up, run=lambda xs: ([], 0))), "ML-INFERENCE-011")
    code(lambda: run(replace(up, run=lambda xs: (["x"], 99))), "ML-INFERENCE-012")
    code(lambda: run(replace(up, run=lambda xs: ([1], 0))), "ML-INFERENCE-013")
    rows = spark.createDataFrame([(k, f"t{k}") for k in range(5)], "id int, text string")
    assert sorted(r.said for r in inference.infer_rows(rows, "text", "said", up, "public", limits=pay).collect()) == [f"T{k}" for k in range(5)]


def test_features_and_vectors(spark):
    s = FeatureSet(FeatureLimits(features=2)).insert("b", 1.0).insert("a", "x")
    assert [n for n, _ in s.items()] == ["a", "b"]
    code(lambda: s.insert("c", True), "ML-FEATURE-005")
    code(lambda: FeatureSet().insert("", 1.0), "ML-FEATURE-001")
    code(lambda: FeatureSet().insert("x", float("nan")), "ML-FEATURE-002")
    code(lambda: FeatureSet().insert("a", 1.0).insert("a", 2.0), "ML-FEATURE-004")
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "id string, v array<float>")
    assert [r.id for r in exact_search(df, "id", "v", [1.0, 0.0], "euclidean", 2).collect()] == ["a", "b"]
    assert [r.id for r in exact_search(df, "id", "v", [0.0, 2.0], "cosine", 1).collect()] == ["c"]
    code(lambda: exact_search(df, "id", "v", [], "cosine", 1), "ML-VECTOR-001")
    with pytest.raises(Exception, match="ML-VECTOR-002"):
        exact_search(df, "id", "v", [1.0], "cosine", 1).collect()
    with pytest.raises(Exception, match="ML-VECTOR-003"):
        exact_search(df, "id", "v", [0.0, 0.0], "cosine", 1).collect()
    for bad in ("", "x" * 1025):
        with pytest.raises(Exception, match="ML-VECTOR-005"):
            exact_search(spark.createDataFrame([(bad, [1.0])], "id string, v array<float>"), "id", "v", [1.0], "euclidean", 1).collect()
    code(approximate_search, "ML-CAPABILITY-001")


def test_placement():
    q = Pipeline.from_model(EVENT).filter(EVENT["score"].gt(1)).distinct().limit(2)
    assert {site for _, site in placement.place(q, placement.SPARK)} == {"engine"}
    narrow = SqlCatalog.capabilities()
    code(lambda: placement.place(q, narrow), "ENGINE-PLACEMENT-001")
    code(lambda: placement.place(q, narrow, placement.Policy(placement.Budget())), "ENGINE-PLACEMENT-003")
    sites = placement.place(q, narrow, placement.Policy(placement.Budget(1, 1, 1)))
    assert [s for _, s in sites] == ["engine", "engine", "local", "local"]
    assert placement.place_ml("exact_search", placement.SPARK) == "engine"
    code(lambda: placement.place_ml("approximate_search", placement.SPARK), "ML-PLACEMENT-001")
    some = placement.Policy(placement.Budget(1, 1, 1))
    assert placement.place_ml("exact_search", narrow, some) == "local_exact"
    code(lambda: placement.place_ml("approximate_search", narrow, some), "ML-PLACEMENT-003")
    code(lambda: placement.place_ml("exact_search", narrow, placement.Policy(placement.Budget())), "ML-PLACEMENT-002")
    assert lit(1, t.U8).op == "literal"


def test_data_set(spark):
    from exactframe.dataset import DataSet
    from exactframe.operators.writes import delete, insert

    two = [dict(id=k, active=True, score=k, tags=[]) for k in (1, 2)]
    d = DataSet(spark, EVENT, two)
    assert [r.score for r in d.filter(EVENT["score"].gt(1))] == [2]
    code(lambda: d.apply(insert(EVENT, two[0])), "DATASET-IDENTITY-001")
    d.apply(delete(EVENT).filter(EVENT["score"].eq(1)))
    d.validate()
    assert len(d.rows()) == 1
    code(lambda: DataSet(spark, EVENT, [two[0], two[0]]), "DATASET-IDENTITY-001")
    code(lambda: DataSet(spark, EVENT, [{"id": 1}]), "RUNTIME-002")


def test_foreign_values(spark):
    from exactframe.expr import bind_value

    class Address:
        type = t.semantic(t.U32, "net/ipv4")

        @staticmethod
        def encode(text):
            return sum(int(x) << 8 * k for k, x in enumerate(reversed(text.split("."))))

    host = ModelBuilder("t/host").field("id", t.U64).field("address", Address.type).identity("id").freeze()
    from exactframe.session import Engine

    e = Engine(spark)
    e.load(host, [dict(id=1, address=Address.encode("10.0.0.1")), dict(id=2, address=5)])
    hit = Pipeline.from_model(host).filter(host["address"].eq(bind_value(Address, "10.0.0.1"))).select(host["id"])
    assert [int(r[0]) for r in e.collect(hit)] == [1]
    code(lambda: host["address"].eq(lit(5, t.U32)), "EXPR-TYPE-006")
