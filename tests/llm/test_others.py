"""Nearest neighbours, chats and the pipeline."""

import collections
import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import ann, chat, exact_dedup, mixing, queries, simhash
from gristmill.llm.common import documents, written

SF = "/root/testdata/sf0.001"


def plain_neighbours(vectors, every, k):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], float)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        scores = ann.exact(np.broadcast_to(x[q], x.shape), x)
        order = [i for i in np.lexsort((ids, -scores)) if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), float(scores[i])) for i in order]
    return out


def found(df):
    out = collections.defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return dict(out)


def test_recall_on_a_whole_table(spark):
    got = found(queries.queries()["op1_ann"](spark, SF))
    want = plain_neighbours([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()], 20, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    score = {(q, i): s for q, v in want.items() for i, s in v}
    assert all(score.get((q, i), s) == s for q, v in got.items() for i, s in v)


@pytest.mark.parametrize("block_rows", [30, ann.BLOCK_ROWS])
def test_edges_of_search(spark, monkeypatch, block_rows):
    monkeypatch.setattr(ann, "GOAL", 1.0)
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=6) * (1 + i % 3)]) for i in range(120)]
    rows += [(1000 + i, rows[3][1]) for i in range(80)]  # one common vector, queries among it
    good = dict(rows)
    bad = [(2000, None), (2020, [0.0] * 6), (2040, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (2060, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 6), (2080, [1.0, 2.0]), (2100, []), (2120, [float("inf")] + [1.0] * 5)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + bad + rows[:2]], "vec_id long, embedding array<double>, rep int").repartition(4)
    got = found(ann.neighbours(df, 20, 10, block_rows))
    want = plain_neighbours(list(good.items()), 20, 10)
    assert got.keys() == want.keys()
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    assert all(len(v) == 10 for v in got.values())
    assert ann.neighbours(df.where("false")).count() == 0
    few = found(ann.neighbours(df.where("vec_id < 4"), 20, 10, block_rows))
    assert {q: [i for i, _ in v] for q, v in few.items()} == {0: [i for i, _ in plain_neighbours(rows[:4], 20, 10)[0]]}
    assert ann.neighbours(df.where("vec_id = 0")).count() == 0


def test_hadamard_keeps_norms_and_probes_contain_the_code():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(20, 16))
    assert np.allclose(np.linalg.norm(ann.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    for functions in (1, 2):
        hasher = ann.Hasher(16, functions)
        codes, probes = hasher.codes(x), hasher.probes(x, 32**functions)
        assert (probes[:, :, 0] == codes).all()
        assert all(len(set(p)) == 32**functions for p in probes[0])


HARD = ["\\### Assistant: </turn> ok", "", "####", "\\", "\\b\\h\\e", "<image 0>", "a: b\n</turn>\n### user: x", "</tu" + "rn>", "é\U0001f600"]


def test_turns_read_back():
    for role in ("user", "assistant", "a: b", "### x", "</turn>", "\\c", ""):
        for text in HARD:
            turn, lo, hi, _ = chat.format_turn(role, text)
            assert chat.read_turn(turn) == (role, text)
            assert chat.unescape(turn[lo:hi]) == (text if role == "assistant" else "")
    turns = [(r, t) for t in HARD for r in ("user", "assistant")]
    text, spans, _ = chat.format_conversation(turns)
    assert chat.read_conversation(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_typed_parts(spark):
    parts = [{"type": "text", "text": "see ##"}, {"type": "text", "text": "# <image 0>"}, {"type": "image", "ref": "a.png", "width": 56, "height": 29}, {"type": "audio", "ref": "b.wav", "seconds": 1.5}, {"type": "document", "ref": "c.pdf", "pages": 3}]
    flat = chat.flatten(parts)
    assert flat.text == "see \\h \\limage 0><image 0><audio 1><document 2>"
    assert [(k, r, n) for k, r, _, n in flat.attachments] == [("image", "a.png", 4), ("audio", "b.wav", 38), ("document", "c.pdf", 1536)]
    assert all(flat.text[at:].startswith(f"<{k} {i}>") for i, (k, _, at, _) in enumerate(flat.attachments))
    text, _, found_ = chat.format_conversation([("user", "hi"), ("user", parts)])
    assert all(text[at:].startswith(f"<{k} ") for k, _, at, _ in found_)
    with pytest.raises(ValueError):
        chat.flatten([{"type": "video"}])
    df = spark.createDataFrame([(1, 0, "user", None, parts), (1, 1, "assistant", "x", None)], "conv_id long, turn long, role string, text string, parts array<struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>")
    got = chat.formatted_turns(df).orderBy("turn").collect()
    assert len(got[0].attachments) == 3 and got[1].formatted == "### assistant: x </turn>\n"


def test_conversation_digest(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", "b"), (1, None, None, "first"), (None, 0, "assistant", "n"), (2, 0, "user", "x"), (2, 0, "user", "x")] + [(3, i, "assistant", f"t{i}") for i in range(2000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(6)
    got = {r.conv_id: r for r in chat.conversation_digest(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("\nfirst\nuser\na\nassistant\n\nassistant\nb\n") and got[1].loss_sha256 == sha("b") and got[1].n_turns == 4
    assert got[3].loss_sha256 == sha("".join(f"t{i}" for i in range(2000))) and got[2].n_turns == 2 and got[2].loss_chars == 0 and got[None].loss_chars == 1
    assert chat.conversation_digest(df.where("false")).count() == 0


def test_pipeline(spark, docs, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs_ = documents(spark, SF)
    steps, now = {}, docs_
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        steps[name] = now = now.cache()
    ids = {k: [r.doc_id for r in v.select("doc_id").collect()] for k, v in steps.items()}
    for name in list(steps)[:-1]:
        assert steps[name].columns == docs_.columns
    text = {r.doc_id: r.text for r in docs_.collect()}
    clean = {i: exact_dedup.normal_digest(text[i])[0] for i in ids["quality"]}
    assert set(ids["exact_dedup"]) == {max((i for i in clean if clean[i] == h), key=lambda i: (len(text[i]), -i)) for h in set(clean.values())}
    assert set(ids["near_dedup"]) <= set(ids["exact_dedup"]) and len(set(ids["near_dedup"])) == len(ids["near_dedup"])
    copies = collections.Counter(ids["mixing"])
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(steps["near_dedup"]).collect()}
    assert copies == {i: n for i, n in plan.items() if n}
    assert sorted(ids["bpe"]) == sorted(ids["mixing"])
    assert steps["bpe"].where(F.size("ids") != F.col("n_tokens")).count() == 0
    before = len(written())
    assert corpus_pipeline.run(spark, SF).count() == len(ids["bpe"])
    assert len(written()) == before + 1
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.where("false"), SF).count() == 0


def test_near_dedup_keeps_one(spark):
    df = spark.createDataFrame([(3, "a b c d", "x"), (1, "a b c d", "y"), (None, "a b c d", "z"), (9, "other words are here", "w")], "doc_id long, text string, component_id string")
    assert sorted(r.component_id for r in simhash.near_dedup(df).collect()) == ["w", "y", "z"]
    assert simhash.near_dedup(df.where("false")).count() == 0


def test_near_dedup_finds_edited_copies(spark):
    """Copies with words replaced, down to a similarity of 0.8, go; texts that share half of their words stay."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    table, near = [], []
    for base in range(40):
        words = [word() for _ in range(300)]
        table.append((3 * base, " ".join(words)))
        copy = list(words)
        for at in rng.choice(300, 5, replace=False):
            copy[at] = word()
        table.append((3 * base + 1, " ".join(copy)))
        near.append(3 * base + 1)
        table.append((3 * base + 2, " ".join(words[:150] + [word() for _ in range(150)])))
    table += [(1000 + i, " ".join(word() for _ in range(int(rng.integers(1, 12))))) for i in range(300)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    left = {r.doc_id for r in simhash.near_dedup(df).collect()}
    assert len(set(near) & left) <= 1
    assert {d for d, _ in table} - set(near) <= left
    simhash.HOT_SHARDS, kept = 10**9, simhash.HOT_SHARDS
    try:
        prints = [(d, *np.frombuffer(simhash.wide_fingerprint(t), ">i8").tolist()) for d, t in table]
        distinct = spark.createDataFrame(prints, "node long, w0 long, w1 long, w2 long, w3 long")
        assert len({r.u for r in simhash.wide_links(distinct, len(prints), 0.8, 5).collect()} & set(near)) >= len(near) - 2
    finally:
        simhash.HOT_SHARDS = kept


def plain_near(table, similarity=0.8, shingle=5):
    """doc_ids that stay by brute force over sets of shingles."""
    sets = {}
    for d, t in table:
        w = t.lower().split()
        sets[d] = {" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))}
    ids, name = sorted(sets), {d: d for d in sets}
    for a, b in itertools.combinations(ids, 2):
        if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
            old, new = max(name[a], name[b]), min(name[a], name[b])
            name = {d: new if n == old else n for d, n in name.items()}
    return {d for d in ids if name[d] == d}


@pytest.mark.parametrize("block", [2_000, 2])
def test_near_dedup_of_repeated_lines(spark, monkeypatch, block):
    """A line repeated over and over neither joins unrelated texts nor parts copies; chains and equal fingerprints' groups are joined."""
    monkeypatch.setattr(simhash, "BLOCK_SETS", block, raising=False)
    rng = np.random.default_rng(3)
    words = lambda n: ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n)]
    line, table = words(10), []
    for i in range(12):
        own = words(200)
        table.append((10 * i, " ".join(own + line * 20)))
        table.append((10 * i + 1, " ".join(own + line * 40)))
        table.append((10 * i + 2, " ".join(own[:-1] + words(1))))
        at = int(rng.integers(20, 120))
        table.append((10 * i + 3, " ".join(own[:at] + words(60) + own[at + 60 :])))
    chain = words(300)
    table += [(500 + k, " ".join(words(12 * k) + chain[12 * k :])) for k in range(4)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    want = plain_near(table)
    assert {10 * i for i in range(12)} <= want and {r.doc_id for r in simhash.near_dedup(df).collect()} == want


def test_joined_sets_join_what_brute_force_joins():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 14, rng.integers(1, 12)).astype(np.uint64)) for _ in range(120)]
    table = list(enumerate(sets))
    name = list(range(len(sets)))
    for (a, x), (b, y) in itertools.combinations(table, 2):
        if len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)):
            old, new = max(name[a], name[b]), min(name[a], name[b])
            name = [new if n == old else n for n in name]
    assert dict(simhash.joined_sets(sets, 0.8)) == {i: n for i, n in enumerate(name) if i != n}
