"""The filter audit, importance resampling and the n-gram join against plain Python; mixed buckets; the pipeline's near copies."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from tallyweir.llm import filter_audit, jaccard_join, line_dedup, near_dedup, quality, resampling

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"
ODD = ["", None, " ", "a", "a b", "x\n\n y\tz", "日本語 テスト É", "WORD " * 3000, "the cat sat # on the mat " * 12, "A B C | d"]


def _space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _plain_audit(rows, labels):
    least, marks = {}, {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(least.get(text or "", doc_id), doc_id)
    for doc_id, good, toxic in labels:
        g, t = marks.get(doc_id, (0, 0))
        marks[doc_id] = max(g, int(good == 1)), max(t, int(toxic == 1))
    fails = []
    for doc_id, text, source in rows:
        t = text or ""
        w = _space_words(t)
        failed = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": doc_id is not None and doc_id > least[t]}
        fails.append((source or "", frozenset(f for f, bad in failed.items() if bad), *(marks.get(doc_id, (0, 0)) if doc_id is not None else (0, 0))))
    out = {}
    for part in {f[0] for f in fails}:
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = [f for f in fails if f[0] == part]
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                all_failed = sum(x[0] == part and f in x[1] for x in fails)
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                only = sum(x[0] == part and x[1] == {f} for x in fails)
                out[part, "".join(order), k + 1] = [len(left), len(gone), all_failed - len(gone), only, sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shapley[order[k - 1]])
    return out


def _audit_rows(n=260, seed=1):
    rng = random.Random(seed)
    texts = [*ODD, *[" ".join(rng.choice(["up", "Down", "SIDE", "x#", "y", "z", *map(str, range(90))]) for _ in range(rng.randint(40, 70))) for _ in range(40)]]
    rows = [(i, rng.choice(texts), rng.choice(["web", "books", None, ""])) for i in range(n)]
    rows += [rows[3], rows[3], rows[9], (None, texts[12], "web"), (None, None, None), (-5, texts[12], "late")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, n, 2)] + [(4, 1, 0), (None, 1, 1)]
    return rows, labels


def _found(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}


def test_filter_audit_retracts(spark, tmp_path):
    rows, labels = _audit_rows()
    marks = filter_audit.marked_labels(spark.createDataFrame(labels, LABELS))
    schema = "doc_id bigint, text string, source string, mask int, part string"
    folder, place = str(tmp_path / "docs"), str(tmp_path / "place")

    def write(part):
        spark.createDataFrame([(*r, 7, "own") for r in part], schema).coalesce(1).write.mode("append").parquet(folder)

    # the largest ids first, so that every smaller one takes an earlier mask back
    order = sorted(rows, key=lambda r: -(r[0] or 0))
    for i in range(0, 160, 40):
        write(order[i : i + 40])
    filter_audit.advance(spark, folder, marks, place, bytes_per_batch=1)
    assert len(spark.read.parquet(f"{place}/changes").select("batch").distinct().collect()) >= 4
    assert _found(filter_audit.report(filter_audit.counters(spark, place))) == _plain_audit(order[:160], labels)
    write(order[160:])
    filter_audit.advance(spark, folder, marks, place, bytes_per_batch=1)
    assert _found(filter_audit.report(filter_audit.counters(spark, place))) == _plain_audit(rows, labels)


def test_filter_audit_of_one_file_and_of_nothing(spark, tmp_path):
    rows, labels = _audit_rows(60, 2)
    folder = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(folder)
    got = filter_audit.audit(spark, folder, spark.createDataFrame(labels, LABELS))
    assert _found(got) == _plain_audit(rows, labels)
    nothing = str(tmp_path / "none")
    spark.createDataFrame([], DOCS).write.parquet(nothing)
    assert filter_audit.audit(spark, nothing, spark.createDataFrame([], LABELS)).count() == 0
    assert _found(filter_audit.audit(spark, folder, spark.createDataFrame([], LABELS))) == _plain_audit(rows, [])


def _plain_resample(rows, targets, longest, buckets, least_words, percent):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    own, aim = [features(t) for _, t in rows], [features(t)[1] for t in targets]
    s, t = collections.Counter(b for _, f in own for b in f), collections.Counter(b for f in aim for b in f)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    scored = []
    for (doc_id, _), (n_words, f) in zip(rows, own, strict=True):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        scored.append((doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words >= least_words))
    able = sorted((x for x in scored if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = able[: percent * len(able) // 100]
    return sorted([(*x[:4], i + 1) for i, x in enumerate(drawn)] + [(*x[:4], None) for x in able[len(drawn) :] + [x for x in scored if not x[4]]], key=repr)


@pytest.mark.parametrize(("longest", "buckets"), [(1, 10_000), (2, 500), (3, 64)])
def test_resampling(spark, longest, buckets):
    rng = random.Random(longest)
    words = ["Alpha", "beta", "été", "x1", "don't", "日本", "go"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(30)] + ["", "--", "same line again"] * 3
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9)))) for i in range(150)]
    rows += [(200 + i, t) for i, t in enumerate(ODD)] + [rows[5], rows[5], (5, "other text " * 20), (None, "nameless " * 30), (None, None)]
    targets = ["beta go beta", None, "", "x1\nalpha été"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("key", F.lit(1)).withColumn("line", F.lit("z"))
    got = resampling.resample(docs, spark.createDataFrame([(t,) for t in targets], "text string"), longest, buckets, least_words=12, percent=30)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == _plain_resample(rows, targets, longest, buckets, 12, 30)


def test_resampling_of_nothing(spark):
    none, some = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert resampling.resample(none, some).count() == 0
    assert [tuple(r) for r in resampling.resample(some, none).collect()] == _plain_resample([(1, "a b")], [], 1, 10_000, 20, 10)


def test_resampling_ranks_without_heavy_lines(spark, monkeypatch):
    # no line counts as heavy: all go through the shuffle join
    monkeypatch.setattr(resampling, "HEAVY", 0)
    rows = [(i, f"w{i % 7} common words\nand line {i % 3}") for i in range(40)]
    got = resampling.resample(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([("w1 w1",)], "text string"), least_words=1, percent=50)
    assert sorted(map(tuple, got.collect()), key=repr) == _plain_resample(rows, ["w1 w1"], 1, 10_000, 1, 50)


def _sets(rows, k):
    out = []
    for _, text in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in _space_words(text)]
        out.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def _components(sets, percent):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, s in enumerate(sets):
        for b in range(a):
            n = len(s & sets[b])
            if n and 100 * n >= percent * (len(s) + len(sets[b]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def _changed_copies(n, seed, longest=40):
    rng = random.Random(seed)
    vocabulary, hot = [f"w{i}" for i in range(60)], [f"h{i}" for i in range(30)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, longest))] for _ in range(n // 8)]
    rows = []
    for i in range(n):
        words = hot + [rng.choice(vocabulary) for _ in range(rng.randint(0, 9))] if rng.random() < 0.3 else list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            if rng.random() < 0.5:
                words.insert(rng.randint(0, len(words)), rng.choice(vocabulary))
            elif len(words) > 1:
                words.pop(rng.randint(0, len(words) - 1))
        rows.append((i, " ".join(words)))
    return [*rows, *[(n + i, t) for i, t in enumerate(ODD)]]


@pytest.mark.parametrize(("k", "percent", "boundary"), [(5, 80, None), (3, 80, 1), (3, 80, 17), (1, 60, 9), (2, 50, None), (1, 100, None)])
def test_jaccard_join(spark, monkeypatch, k, percent, boundary):
    if boundary:
        monkeypatch.setattr(jaccard_join, "_boundary", lambda lists, percent: boundary)
    rows = _changed_copies(240, k + percent, 24 if boundary else 40)
    sets = _sets(rows, k)
    want = {rows[i][0]: (len(sets[i]), rows[root][0]) for i, root in enumerate(_components(sets, percent))}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).withColumn("n", F.lit("x")).withColumn("id", F.lit(1))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, k, percent).collect()} == want


def test_jaccard_join_edges(spark):
    text = " ".join(f"a{i}" for i in range(40))
    near = text + " more"
    rows = [(7, text), (7, text), (None, near), (3, near), (None, "alone here"), (5, None), (5, ""), (9, "one"), (8, "one"), (None, "x y"), (None, "x y")]
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=repr)
    assert got == sorted([(7, 36, 3), (7, 36, 3), (None, 37, 3), (3, 37, 3), (None, 1, None), (5, 0, 5), (5, 0, 5), (9, 1, 8), (8, 1, 8), (None, 1, None), (None, 1, None)], key=repr)
    assert jaccard_join.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize(("a", "b", "percent"), [(5, 6, 80), (16, 13, 80), (100, 125, 80), (7, 7, 33), (1, 1, 100), (3, 9, 33)])
def test_needed(a, b, percent):
    n = jaccard_join.needed(a, b, percent)
    assert 100 * n >= percent * (a + b - n) and not 100 * (n - 1) >= percent * (a + b - n + 1)
    assert (b in jaccard_join.partners(a, percent)) == (100 * min(a, b) >= percent * max(a, b))


def test_many_unlinked_lines_in_a_bucket(spark):
    # lines that share 100 of 120 characters fall into common buckets and are not linked: 5,000 of them took minutes pair by pair
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    common = "".join(rng.choice(letters) for _ in range(100))
    rows = [(i, common + "".join(rng.choice(letters) for _ in range(20))) for i in range(5_000)]
    rows += [(5_000 + i, rows[i][1][:-1] + "!") for i in range(20)]
    began = time.time()
    got = {r.doc_id for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert time.time() - began < 90
    assert len(set(range(5_000, 5_020)) - got) <= 1 and all(i >= 5_000 for i in got)


def test_near_dedup_of_boilerplate(spark):
    # a passage of 60 words in every document, and near copies among them
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"u{rng.randint(0, 10**9)}" for _ in range(rng.randint(8, 30))])) for i in range(600)]
    rows += [(600 + i, rows[i][1] + " tail") for i in range(30)]
    want = _components(_sets(rows, 5), 80)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i] for i, _ in rows] == want


def test_pipeline_removes_near_copies_in_near_dedup(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(11)
    common = ["the", "of", "and", "to", "in", "a", "is", "that", "it", "was"]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 8)))
    line = lambda: " ".join(word() for _ in range(14))
    shared = line()
    texts = [[*[line() for _ in range(8)], shared] for _ in range(30)]
    rows = [(i, "\n".join(t), "en", "s", 0) for i, t in enumerate(texts)]
    for i in range(6):  # near copies: two words changed
        copy = [x.split() for x in texts[i]]
        copy[0][3], copy[2][5] = "changed", "words"
        rows.append((100 + i, "\n".join(" ".join(x) for x in copy), "en", "s", 0))
    rows.append((200, "\n".join(texts[7]), "en", "s", 0))  # an exact copy
    rows.append((300, "\n".join([*texts[8][:5], line()]), "en", "s", 0))  # lines of another, which leave too little
    docs = spark.createDataFrame(rows, DOCS)
    stages = dict(corpus_pipeline.STAGES)
    cut = spark.createDataFrame(stages["line_dedup"](spark, docs, "").collect(), DOCS)
    kept = {r.doc_id: r.text for r in cut.collect()}
    assert {*range(30), *range(100, 106), 200} == set(kept)
    # the shared line stays with the first document and its copy
    assert {i for i, t in kept.items() if shared in t} == {0, 100}
    assert all(len(_space_words(t)) >= 50 for t in kept.values())
    left = {r.doc_id for r in stages["near_dedup"](spark, cut, "").collect()}
    assert left == set(range(30))
    assert cut.where(~quality.passes_base(F.col("text"))).count() == 0
