"""Each stage of the pipeline on its own input, against brute force."""

import collections
import re
import tracemalloc
import unicodedata
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
import public_tokenizers
from exactframe.llm import common, minhash, packing
from exactframe.llm.quality import BOILERPLATE, NAVIGATION

SF = "/root/testdata/sf0.001"
LETTER = r"[^\W\d_]"


@pytest.fixture(scope="module")
def stages(spark):
    out = [common.table(spark, SF, "documents")]
    for _, f in corpus_pipeline.STAGES:
        out.append(common.stored(f(spark, out[-1], SF), "test"))
    return [x.collect() for x in out]


def words(t):
    return (t or "").encode().split()


def bad_line(line):
    low, w = line.lower(), [x.decode() for x in words(line)]
    n = len(w)
    marks, symbols = len(re.findall("[|»›•·]", low)), len(re.findall(r"[#*$%&|<>]", low))
    item = re.sub(rf"^(?:(?!{LETTER}).)+|(?:(?!{LETTER}).)+$", "", low)
    same = sum(a == b for a, b in zip(w, w[1:], strict=False))
    up, cased = sum(unicodedata.category(c) == "Lu" for c in line), sum(unicodedata.category(c) in ("Lu", "Ll") for c in line)
    two = any(unicodedata.category(a) == unicodedata.category(b) == "Lu" for a, b in zip(line, line[1:], strict=False))
    return (
        not re.search(LETTER, low) or (two and n >= 4 and up * 100 > cased * 60) or (len(low) <= 60 and item in NAVIGATION) or (symbols > 2 and symbols >= n) or (marks >= 2 and n <= (marks + 1) * 4)
        or (n <= 25 and any(p in low for p in BOILERPLATE)) or same * 100 > n * 30
    )


def clean_lines(text):
    lines = text.split("\n")
    few = [0 < len(words(x)) <= 3 and len(x) <= 200 and bool(re.search(LETTER, x)) and not re.search(r"[.!?:;…。！？।؟][\W_]*$", x) for x in lines]
    run = [any(all(0 <= j < len(few) and few[j] for j in range(k, k + 3)) for k in range(i - 2, i + 1)) for i in range(len(lines))]
    return "\n".join(x for x, r in zip(lines, run, strict=True) if not words(x) or not (r or bad_line(x)))


def test_line_rules(spark):
    from exactframe.llm.quality import judge

    menu = "Startseite\nÜber uns\nKontakt\nImpressum"
    body = "Ein langer Satz mit vielen Wörtern steht hier, damit genug Text bleibt.\nUnd noch ein Satz, der auch bleiben soll."
    ts = [f"{menu}\n{body}", f"{body}\nEins\nZwei\n\nDrei", f"{body}\nJETZT KAUFEN UND VIEL GELD SPAREN\nDie NATO und die EU tagen.", f"Eins.\nZwei!\nDrei\n{body}", "а б\nв\nг"]
    got = [r.q.clean_text for r in judge(spark.createDataFrame(list(enumerate(ts)), "k int, text string"), out="q").orderBy("k").collect()]
    assert got == [body, ts[1], f"{body}\nDie NATO und die EU tagen.", ts[3], ""]
    assert got == [clean_lines(t) for t in ts]


def test_quality_stage(stages):
    want = {}
    for r in stages[0]:
        w = words(r.text)
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        clean = clean_lines(r.text or "")
        count = lambda t: len(b"".join(words(t)).decode())
        if len(w) >= 20 and 100 * len(cover) <= 30 * len(w) and count(clean) * 100 >= count(r.text) * 50:
            want[r.doc_id] = clean
    assert {r.doc_id: r.text for r in stages[1]} == want
    assert all(r.n_chars == len(r.text) for r in stages[1])


def test_language_stage(stages):
    assert {r.doc_id for r in stages[2]} == {r.doc_id for r in stages[1]}  # all are in languages that are known
    given = {r.doc_id: r.lang for r in stages[1]}
    assert np.mean([r.lang == given[r.doc_id] for r in stages[2]]) > 0.98


def test_dedup_stage(stages):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for r in stages[2]:
        w = r.text.encode().translate(lower).split()
        sets[r.doc_id] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)])
    up = {k: k for k in sets}

    def find(x):
        return x if up[x] == x else find(up[x])

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in stages[3]) == sorted(k for k in sets if find(k) == k)


def test_mixing_stage(stages):
    size, source = {}, collections.Counter()
    for r in stages[3]:
        size[r.doc_id] = len(words(r.text))
        source[r.source] += size[r.doc_id]
    names = sorted(source)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, target, left = sum(source.values()), {}, dict(weight)
    while True:
        share = (total - sum(target.values())) / sum(left.values())
        over = [s for s in left if left[s] * share > 3 * source[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * source[s]
            del left[s]
    target |= {s: left[s] * share for s in left}
    got, by_doc = collections.Counter(), collections.Counter()
    texts = {r.doc_id: r.text for r in stages[3]}
    for r in stages[4]:
        n = len(words(r.text))
        got[r.source] += n
        by_doc[r.doc_id] += n
        assert r.text == texts[r.doc_id] or not collections.Counter(words(r.text)) - collections.Counter(words(texts[r.doc_id]))
    assert all(by_doc[k] <= 3 * size[k] for k in size)
    for s in names:
        assert abs(got[s] - target[s]) <= max(0.05 * target[s], 130)


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for r in stages[4]:
        want[r.doc_id] += len(t.encode(r.text, add_special_tokens=False).ids) + 1
    got = collections.Counter()
    used, ids = collections.Counter(), collections.defaultdict(list)
    for r in stages[5]:
        got[r.doc_id] += r.length
        used[r.sequence_id] += r.length
        ids[r.doc_id].append(np.frombuffer(r.ids, "<u4"))
        assert len(r.ids) == 4 * r.length
    for k, pieces in ids.items():
        expected = collections.Counter(i for r in stages[4] if r.doc_id == k for i in [*t.encode(r.text, add_special_tokens=False).ids, 1])
        assert collections.Counter(np.concatenate(pieces).tolist()) == expected
    assert got == want and max(used.values()) <= 2048


def test_run_is_the_stages(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == len(stages[-1])


LONG = " ".join(f"word{k}" for k in range(60)) + "."
ODD = [
    (1, LONG, "en", "a", 5), (1, LONG, "en", "a", 5), (2, LONG + " And more of it.", "en", None, None), (3, None, "en", "a", None), (4, "", None, "a", 0),
    (None, LONG, "en", "a", 1), (None, LONG, "en", "a", 1), (5, "Other " + LONG.replace("word", "term"), None, "b", 1), (5, "Another " + LONG.replace("word", "name"), "en", "b", 1),
    (6, "long " + " ".join(f"unit{k}" for k in range(40_000)), "en", "b", 1), (7, " \n\t ", "en", "b", 1),
]


def odd_table(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(ODD, schema).selectExpr("*", "'x' as id", "1 as component_id", "'y' as kept", "array(1) as q", "2 as size")


@pytest.mark.parametrize("k", range(5))
def test_stages_with_odd_rows(spark, k):
    """Nulls in any column, empty and very long texts, ties, repeated rows, rows of one id, clashing columns, and no rows."""
    df = odd_table(spark)
    name, stage = corpus_pipeline.STAGES[k]
    rows = stage(spark, df, SF).collect()
    ids = sorted((r.doc_id for r in rows), key=str)
    if k < 4:
        assert tuple(rows[0].asDict()) == corpus_pipeline.DOC
    if name == "quality rules":
        assert ids == [1, 1, 2, 5, 5, 6, None, None]
    elif name == "language ID":
        assert set(ids) <= {1, 2, 5, 6, None} and {1, 2, 6} <= set(ids) and {r.lang for r in rows} == {"en"}
    elif name == "MinHash near-dedup":
        assert ids == [1, 3, 4, 5, 6, 7, None, None]  # 2 is a near copy of 1
        assert next(r for r in rows if r.doc_id == 5).text.startswith("Another")
    elif name == "mixing":
        assert set(ids) <= {1, 2, 5, 6, None} and all(r.n_chars == len(r.text) > 0 for r in rows)
    else:
        assert set(ids) == {1, 2, 3, 4, 5, 6, 7, None} and [r.length for r in rows if r.doc_id in (3, 4, 7)] == [1, 1, 1]
        assert sum(r.length for r in rows if r.doc_id == 1) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 1)
    assert stage(spark, df.limit(0), SF).count() == 0


def test_run_leaves_only_what_its_result_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert len([x for x in tmp_path.iterdir() if x.name.startswith("exactframe-")]) == 1


def test_texts_go_to_python_in_small_batches(spark):
    was = {k: spark.conf.get(k) for k in (corpus_pipeline.BATCH, corpus_pipeline.BYTES)}
    try:
        for k in was:
            spark.conf.unset(k)
        corpus_pipeline.modest(spark)
        sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
        got = [r.n for r in spark.range(0, 2000, 1, 1).selectExpr("repeat('x', 10000) as text").mapInArrow(sizes, "n long").collect()]
        assert sum(got) >= 20_000_000 and max(got) < 3_000_000
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_packing_does_not_depend_on_batches(monkeypatch):
    monkeypatch.setattr(packing.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    rng = np.random.default_rng(6)
    texts = [" ".join(["word"] * int(n)) for n in rng.integers(0, 300, 4500)]
    table = pa.table({"doc_id": range(4500), "text": texts})
    pack = lambda n: pa.Table.from_batches(packing._packed(public_tokenizers.path("word_bpe_49k.json"), 1, packing.Limits(), True)(iter(table.to_batches(max_chunksize=n))))
    assert pack(300).to_pylist() == pack(5000).to_pylist()


def test_sketches_take_little_memory():
    table = pa.table({"doc_id": range(1500), "text": [" ".join(f"w{k * 7 + j}" for j in range(500)) for k in range(1500)]})
    tracemalloc.start()
    assert sum(b.num_rows for b in minhash._sketch(iter(table.to_batches(max_chunksize=500)))) == 1500
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16 << 20
