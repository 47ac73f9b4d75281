"""The training-data operators against brute force, on small tables with nulls, empty and repeated texts."""

import hashlib
import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from contestry.llm import align, bpe, chat, cuckoo, fingerprint, lines, minhash, mixing, packing, periodic, pst, queries, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, digest string, n long"


def words(text):
    return WORD.findall((text or "").translate(FOLD))


@pytest.fixture(scope="module")
def docs(spark, sf):
    base = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    odd = [(900, None, None, None, None), (901, "", "en", "x", 0), (902, " \n\t ", "en", "x", 4), (903, "one two", "en", "x", 7), (904, "one two", "en", "x", 7), (905, "a " * 5000, "en", "x", 10000)]
    rows = [(*r, "d", 1) for r in base + odd]
    return spark.createDataFrame(rows, COLUMNS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_suffix_tree(spark, docs, empty):
    got = {r.doc_id: r for r in pst.score(spark, docs).collect()}
    tokens = {i: [*words(t), None] for i, t in texts(docs).items()}
    count = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    total = sum(count.values())
    for i, ws in tokens.items():
        base = sum(np.log10((count[w] + 1) / (total + len(count) + 1)) for w in ws)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws), sum(w in count for w in ws), total)
        assert got[i].base_score == pytest.approx(base) and got[i].score <= 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert pst.score(spark, empty).count() == 0


def test_suffix_tree_scores_against_brute_force(spark, docs):
    least, divergence, strength = 3, 0.02, 5.0
    got = {r.doc_id: r.score for r in pst.score(spark, docs, 2, least, divergence, strength).collect()}
    tokens = {i: [*words(t), None] for i, t in texts(docs).items()}
    grams = Counter()
    for i, ws in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            grams.update(tuple(ws[j - d : j + 1]) for j in range(len(ws)) for d in range(min(j, 2) + 1))
    single = {g[0]: n for g, n in grams.items() if len(g) == 1}
    total, once, twice = sum(single.values()), *(sum(n == k for n in single.values()) for k in (1, 2))
    cut = once / (once + 2 * twice) if once and twice else 0.5
    after, kept = {}, set()
    for g in grams:
        after.setdefault(g[:-1], []).append(g[-1])

    def p(context, w):
        if not context:
            return (single[w] - cut if w in single else cut * len(single)) / total
        below = p(context[1:], w)
        return (grams[(*context, w)] + strength * below) / (grams[context] + strength) if context in kept else below

    for d in (1, 2):
        for c in [c for c in after if len(c) == d and grams[c] >= least and (d == 1 or c[1:] in kept)]:
            gain = 0.0
            for w in after[c]:
                n, below = grams[(*c, w)], p(c[1:], w)
                gain += n * np.log((n - 1 + strength * below) / (grams[c] + strength - 1) / below)
            if gain >= divergence * grams[c]:
                kept.add(c)
    assert {len(c) for c in kept} == {1, 2}
    for i, ws in tokens.items():
        want = sum(np.log10(p(tuple(ws[max(0, j - 2) : j]), w) if tuple(ws[max(0, j - 2) : j]) in kept else p(tuple(ws[max(0, j - 1) : j]), w)) for j, w in enumerate(ws))
        assert got[i] == pytest.approx(want, abs=1e-6), i


def test_suffix_tree_keeps_a_context_in_a_large_corpus(spark):
    """A context seen 40 times is a state beside 800,000 tokens as it is beside 800."""
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % pst.FOLDS != pst.HELD]
    for filler in (800, 800_000):
        rows = [(i, "aa bb") for i in ids[:40]] + [(ids[40], " ".join(f"w{j % 5000}" for j in range(filler)))]
        got = {r.doc_id: r for r in pst.score(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got[ids[0]].train_tokens == filler + 40 * 3 + 1
        assert got[ids[0]].score - np.log10(40 / got[ids[0]].train_tokens) > 2 * np.log10(40 / 140) - 0.1


def test_packing(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    options = queries.tokenizer()
    slow = tokenizers.Tokenizer.from_file(options["json_path"])
    out = packing.pack(docs, **options).collect()
    by, bins = defaultdict(list), defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    for i, text in texts(docs).items():
        ids, at = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in bins.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0
    assert packing.pack(empty, **options).count() == 0


@pytest.mark.parametrize("cut", [True, False])
def test_bins_keep_all_limits(cut):
    r, bins = np.random.default_rng(1), packing.Bins(64, 3, 20, cut, window=32)
    sizes = r.integers(1, 150, 300)
    for key, n in enumerate(sizes):
        bins.add(key, int(n), int(r.integers(0, n + 1)))
    bins.finish()
    seen, sums = defaultdict(int), defaultdict(lambda: [0, 0, 0])
    for key, a, b, sequence, offset, loss in bins.done:
        seen[key] += b - a
        assert offset == sums[sequence][0]
        for i, x in enumerate((b - a, 1, loss)):
            sums[sequence][i] += x
    assert [seen[k] for k in range(300)] == sizes.tolist()
    assert all(t <= 64 and s <= 3 and w <= 20 for t, s, w in sums.values())


def test_exact_dedup(spark, docs, empty):
    both = docs.union(docs.limit(3))
    groups = defaultdict(list)
    for r in both.collect():
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r.text or "").encode()).hexdigest()].append(r)
    got = cuckoo.dedup(spark, both).collect()
    assert len(got) == both.count()
    for r in got:
        group = groups[r.text_sha256]
        best = min(group, key=lambda x: (-len(x.text or ""), x.doc_id))
        assert (r.keep_id, r.group_size, r.kept) == (best.doc_id, len(group), r.doc_id == best.doc_id)
    kept = cuckoo.keep_rows(spark, docs)
    assert kept.columns == docs.columns and kept.count() == len({k for k in groups})
    assert cuckoo.dedup(spark, empty).count() == 0


def test_exact_dedup_keeps_one_row_of_a_group(spark):
    rows = [(5, "a b", "x"), (5, "ab", "y"), (6, "ab", "z"), (None, "c d", "x"), (None, "cd", "y"), (None, "", "e"), (None, None, "e")]
    rows += [(7, "e f", "x"), (7, "e f", "x"), (7, "ef ", "y"), (8, "ef", "x"), (9, "g", "x")]
    kept = cuckoo.keep_rows(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = sorted(((r.doc_id, r.text, r.source) for r in kept.collect()), key=str)
    assert len(got) == 5 and all(r in rows for r in got)
    assert {(5, "a b", "x"), (None, "c d", "x"), (9, "g", "x")} < set(got) and sorted(r[0] or 0 for r in got) == [0, 0, 5, 7, 9]


def test_cuckoo_deletes_and_resizes(spark, docs):
    index, keys = cuckoo.Cuckoo(4), [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        index.insert(k, i, i)
        index.insert(k, i, i + 1)
    assert index.n > 4 and all(index.find(k) for k in keys)
    for k in keys[::2]:
        assert index.delete(k) and index.find(k) and index.delete(k)
    assert not any(index.find(k) for k in keys[::2]) and all(index.find(k) for k in keys[1::2])
    assert not index.delete(keys[0]) and len(list(index.items())) == 1500
    rows = cuckoo.digests(docs)
    full = cuckoo.update(cuckoo.empty_index(spark), rows, shards=4)
    assert cuckoo.update(full, None, rows, shards=4).count() == 0


def test_toxicity(spark, docs, empty):
    bad = [(2000 + i, f"und der text {'scumwort' + chr(97 + i % 5)} die das {i}", i % 2) for i in range(400)]
    clean = [(i, t if y else t.replace("scumwort", "gutes"), y) for i, t, y in bad]
    labelled = spark.createDataFrame([(i, y) for i, _, y in clean] + [(1, None), (None, 1)], "doc_id long, toxic int")
    table = spark.createDataFrame([(i, t, None, None, None, "d", 1) for i, t, _ in clean], COLUMNS).union(docs)
    got = {r.doc_id: r for r in toxicity.predictions(spark, table, labelled).collect()}
    assert len(got) == table.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(got[i].predicted, y) for i, _, y in clean if got[i].held_out]
    assert len(held) > 40 and np.mean([p == y for p, y in held]) > 0.95
    kept = toxicity.keep_rows(spark, table, labelled)
    assert kept.columns == table.columns and kept.count() == sum(r.predicted == 0 for r in got.values())
    assert toxicity.predictions(spark, empty, labelled).count() == 0
    assert {r.score for r in toxicity.predictions(spark, docs, labelled.limit(0)).collect()} == {0.0}


def test_quality(spark, docs, empty, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.predictions(spark, docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert quality.predictions(spark, empty, labels).count() == 0
    r = np.random.default_rng(3)
    good, bad = r.normal(1, 1, (4000, 4)), r.normal(-1, 1, (1200, 4))
    web = np.concatenate([good[2000:3200], bad[:800]])
    prior = quality.class_prior(good[:2000], web)
    assert abs(prior - 0.6) < 0.1
    net = quality.train(good[:2000], web, prior)
    assert (net.logits(good[3200:]) > 0).mean() > 0.9 and (net.logits(bad[800:]) > 0).mean() < 0.15


def test_mixing(spark, docs, empty):
    many = spark.range(20000).selectExpr("id AS doc_id", "cast(id AS string) AS text", "CASE WHEN id % 10 < 8 THEN 'a' WHEN id % 10 = 8 THEN 'b' END AS source", "1 AS _u")
    out = mixing.replicate(spark, many, {"a": 1.0, "b": 2.0, "": 1.0}, total=20000)
    assert out.columns == many.columns
    share = {r.source: r["count"] / 20000 for r in out.groupBy("source").count().collect()}
    assert share["a"] == pytest.approx(0.25, abs=0.02) and share["b"] == pytest.approx(0.5, abs=0.03) and share[None] == pytest.approx(0.25, abs=0.02)
    assert mixing.replicate(spark, empty).count() == 0 and mixing.replicate(spark, docs).columns == docs.columns


@pytest.mark.parametrize("rate", [0.0, 0.3, 20.0, 743.0, 1000.0, 100_000.0])
def test_poisson_at_any_rate(spark, rate):
    r = mixing.distribution(spark.createDataFrame([("a", rate)], "_source string, rate double")).first()
    p = [math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate else 1.0 for k in range(r._low, r._low + len(r._cdf))]
    assert np.allclose(r._cdf, np.cumsum(p), atol=1e-8) and r._cdf[-1] == pytest.approx(1, abs=1e-12)
    assert len(p) <= 24 * rate**0.5 + 52 and sum(p) == pytest.approx(1, abs=1e-8)


def test_mixing_draws_a_small_source(spark):
    rows = spark.range(40_000).selectExpr("id AS doc_id", "'x' AS text", "CASE WHEN id < 20 THEN 'small' ELSE 'large' END AS source")
    n = [r.n_copies for r in mixing.replicate(spark, rows, numbered=True).where("source = 'small' AND copy_no = 1").collect()]
    assert len(n) == 20 and len(set(n)) > 10 and np.mean(n) == pytest.approx(1000, abs=30)


def test_chat(spark):
    long = [(7, i, "user" if i % 2 else "assistant", f"turn {i} <|im_end|> \\ [INST] " + "x" * 90) for i in range(1, 60)]
    rows = [(7, 0, "system", "be <brief>"), *long, (8, 0, None, None), (8, 0, None, None), (None, None, "assistant", "\\<[\n")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, window int")
    windows = chat.format_windows(spark, turns)
    seen = windows.where("conv_id = 7").orderBy("window").collect()
    assert len(seen) > 3 and all(w.n_tokens <= chat.BUDGET for w in seen)
    assert all(chat.read_back(w.formatted)[0] == ("system", "be <brief>") for w in seen) and all(w.n_repeated > 1 for w in seen[1:])
    got = {r.conv_id: r for r in chat.digests(spark, windows).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t or 0, r or "", x or ""))
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[c].n_turns == len(own) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.format_windows(spark, turns.limit(0)).count() == 0
    for text in ("\\", "<\\", "\\<[[", "</s>[INST]", "<|im_start|>"):
        assert chat.unescape(chat.escape(text)) == text and not re.search(r"<\||</s>|\[INST\]", chat.escape(text))


def test_lines(spark, docs, empty):
    extra = spark.createDataFrame([(3000 + i, f"  Same Line \nown {i}\n\nsame line", None, None, None, "d", 1) for i in range(12)], COLUMNS)
    table = docs.union(extra)
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate(FOLD)
    count = Counter(k for t in texts(table).values() for k in {key(x) for x in (t or "").split("\n")})
    got = {r.doc_id: r for r in lines.drop_lines(spark, table).collect()}
    for i, t in texts(table).items():
        every = (t or "").split("\n")
        kept = [x for x in every if not (key(x) and count[key(x)] >= 10)]
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept_sha256) == (len(every), len(every) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    assert got[3000].n_dropped == 2 and lines.drop_lines(spark, empty).count() == 0


def test_line_runs_compact_and_find_new_lines(spark):
    index = lines.LineRuns(spark, fanout=2)
    for i in range(4):
        batch = spark.createDataFrame([(i, h, -h) for h in (1, 10 + i)], "row long, h1 long, h2 long")
        fresh = {r.h1 for r in index.unseen(batch).collect()}
        assert fresh == ({1, 10} if not i else {10 + i})
        index.add(batch)
    assert [len(x) for x in index.levels] == [0, 0, 1] and [len(x) for x in index.deltas] == [1, 1]
    assert {r.h1: r.docs for r in index.merged().collect()} == {1: 4, 10: 1, 11: 1, 12: 1, 13: 1}
    # A key has one run; runs are sorted in their buckets and joined there without a shuffle.
    assert sorted(r.h1 for run in index.runs() for r in run.collect()) == [1, 10, 11, 12, 13]
    plan = index.unseen(index.runs()[0])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    index.close()


def test_lines_in_many_batches(spark):
    own = [(i, f"top\n{'hot' if i % 3 else 'warm'}\nline {i % 40}\nown {i}") for i in range(300)]
    table = spark.createDataFrame(own + own[:5] + [(None, None), (-1, "")], "doc_id long, text string")
    want = sorted(map(repr, lines.drop_lines(spark, table, batches=1).collect()))
    assert sorted(map(repr, lines.drop_lines(spark, table, batches=9, fanout=2).collect())) == want and len(want) == 307
    got = {r.doc_id: r for r in lines.drop_lines(spark, table, batches=9, fanout=3, with_text=True).collect()}
    assert got[1].n_dropped == 2 and got[1].kept_text == "line 1\nown 1" and got[None].n_dropped == 0


def test_fingerprints(spark, docs, empty):
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark, docs).collect()}
    rows = sorted(texts(docs).items())
    true, found = [], []
    for (i, t), (_, follower) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, follower = t or "", follower or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + follower[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = Counter(WORD.findall(t)), Counter(WORD.findall(edited))
        true.append(sum((a & b).values()) / max(1, sum((a | b).values())) if a or b else 1.0)
        found.append(got[i].near_edited)
    assert got[903].fingerprint == got[904].fingerprint and got[903].near_next == 1.0
    assert abs(np.mean(true) - np.mean(found)) < 0.05 and np.mean(np.abs(np.subtract(true, found))) < 0.12
    assert fingerprint.fingerprints(spark, empty).count() == 0


def test_fingerprint_ranges_follow_the_rows(spark):
    """One id far off, null ids and one row repeated often: every row finds its successor, and no range holds most rows."""
    rows = [(10**15, "far")] + [(i, f"t{i} a b c d") for i in range(2000)] + [(None, f"n{i} x y") for i in range(300)] + [(7, "same one")] * 900
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprint.fingerprints(spark, table)
    last, first = got.where("doc_id = 1000000000000000").first(), min(f"n{i} x y" for i in range(300))
    assert got.count() == len(rows) and last.n_chars == 3
    edits = Counter(r.edited_sha256 for r in got.where("doc_id = 7").collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert edits[sha("samesame")] >= 898 and sum(edits.values()) == 901
    by_id = {r.doc_id: r.edited_sha256 for r in got.where("doc_id BETWEEN 100 AND 1998").collect()}
    assert all(by_id[i] == sha((t := f"t{i} a b c d")[: len(t) - len(t) // 2] + f"t{i + 1} a b c d"[: len(t) // 2]) for i in by_id)
    assert last.edited_sha256 in {sha("fa" + f"n{i} x y"[:1]) for i in range(300)} and first
    cells = fingerprint._ranged(spark, table.selectExpr("doc_id", "xxhash64(text) AS h", "text")).where("NOT guest").groupBy("cell").count()
    assert max(r["count"] for r in cells.collect()) < len(rows) / 4


def test_near_duplicates(spark, docs, empty):
    r = np.random.default_rng(2)
    base = [f"w{i}" for i in range(120)]
    copies = []
    for i in range(40):
        own = list(base)
        for at in r.integers(0, 120, i % 6):
            own[at] = f"e{i}x{at}"
        copies.append((4000 + i, " ".join(own), None, None, None, "d", 1))
    table = docs.union(spark.createDataFrame(copies, COLUMNS))
    sets = {}
    for i, t in texts(table).items():
        w = words(t)
        sets[i] = {tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: r for r in minhash.near_duplicates(spark, table).collect()}
    assert {i: (g.n_shingles, g.component_id, g.kept) for i, g in got.items()} == {i: (len(sets[i]), root(i), root(i) == i) for i in ids}
    assert minhash.keep_rows(spark, table).columns == table.columns and minhash.near_duplicates(spark, empty).count() == 0


@pytest.fixture(scope="module")
def vocabularies():
    return {"ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN, "model_path": public_tokenizers.path("piece_bpe_32k.model")}


def odd_texts():
    """Texts that put cuts, white space and bytes beyond ASCII next to each other."""
    rng = random.Random(5)
    letters = "ab1 '\n\t.,!?sé日　 \xa0\x1c\x85_-9'llv re<s>▁"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)]


def test_bpe_chunks_are_exact():
    """Tiny chunks and runs give the library's ids of the whole text."""
    small = bpe.Ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, chunk=7, long_run=3)
    for t in odd_texts():
        ids = small.encode(t)
        assert ids.tolist() == small.encoding.encode_ordinary(t) and small.decode(ids) == t.encode()
        assert "".join(part for part, _ in small.chunks(t)) == t
    big = bpe.Ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for t in (" " * 1_200_000, " " * 1_200_000 + "a", "a " * 200_000 + "\n" * 1_200_000 + "b c", "<|endoftext|>"):
        assert big.decode(big.encode(t)) == t.encode()
    with pytest.raises(Exception):  # noqa: B017
        big.decode(np.array([50256], "<u4"))


def test_bpe(spark, docs, empty):
    got = {r.doc_id: r for r in docs.transform(_op11).collect()}
    ranks = bpe.Ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for i, t in texts(docs).items():
        ids = ranks.encoding.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids) and got[i].data == (t or "").encode()
        assert got[i].ids == np.array(ids, "<u4").tobytes()
    odd = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_tokens) for r in _op11(odd).collect()) == [("1", 2), ("1", 2), ("2", 0), ("None", 2)]
    assert _op11(empty).count() == 0
    path = {"ranks_path": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    assert bpe.encode(odd, **path, packed=False).where("doc_id = 1").first().ids == ranks.encoding.encode_ordinary("a b")


def _op11(docs):
    path = {"ranks_path": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    return bpe.decode(bpe.encode(docs, **path), **path)


def _overlaps(a, b):
    """(links, groups) by comparing all tokens of a text with all others."""
    def spans(tokens):
        ends = np.cumsum([len(x) for x in tokens]).tolist()
        return list(zip([0, *ends], ends, strict=False))

    sa, sb = spans(a), spans(b)
    links = [(i, j) for i, x in enumerate(sa) for j, y in enumerate(sb) if x[0] < y[1] and y[0] < x[1]]
    cuts = sorted({e for _, e in sa} & {e for _, e in sb})
    groups = [([i for i, s in enumerate(sa) if p <= s[0] < c], [j for j, s in enumerate(sb) if p <= s[0] < c]) for p, c in zip([0, *cuts], cuts, strict=False)]
    return links, groups


def test_alignment(spark, empty, vocabularies):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = SentencePieceProcessor(model_file=vocabularies["model_path"])
    a_bytes = bpe.Ranks(vocabularies["ranks_path"], vocabularies["pattern"]).token_bytes()
    rows = [*enumerate([*odd_texts()[:150], "", None, "word " * 300, "the cat sat on the mat"]), (None, "the cat"), (7, "the cat"), (7, "the cat")]
    want, pairs = [], Counter()
    for i, t in rows:
        spaced = " " + (t or "")
        a = a_model.encode(spaced, add_special_tokens=False).ids if t else []
        b = b_model.encode(t) if t else []
        bb = [bytes([int(p[3:5], 16)]) if b_model.is_byte(x) else p.replace("▁", " ").encode() for x in b for p in [b_model.id_to_piece(x)]]
        if b"".join(bb) != spaced.encode():
            a = b = bb = []
        links, groups = _overlaps([a_bytes[x] for x in a], bb)
        pairs.update((a[x], b[y]) for x, y in links)
        want.append((i, a, b, [(a[x], b[y]) for x, y in links], groups))
    assert sum(not x[1] for x in want) > 3  # texts that hold the model's own space mark among them
    top = defaultdict(int)
    for (_, y), n in pairs.items():
        top[y] = max(top[y], n)
    expected = []
    for i, a, b, links, groups in want:
        text = ";".join(",".join(str(a[x]) for x in ga) + "|" + ",".join(str(b[y]) for y in gb) for ga, gb in groups)
        expected.append((str(i), len(a), len(b), len(groups), len(links), sum(pairs[p] == top[p[1]] for p in links), sum(pairs[p] for p in links), text))
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, groups int").repartition(3)
    got = align.alignment(spark, frame, **vocabularies)
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == sorted(expected)
    tokens = {str(r.doc_id): r for r in align.token_groups(frame, **vocabularies).collect()}
    for i, a, b, _, groups in want:
        r = tokens[str(i)]
        if i != 7:
            assert (r.a_ids, r.b_ids) == (a, b)
            assert r.a_groups == [g for g, (x, _) in enumerate(groups) for _ in x] and r.b_groups == [g for g, (_, y) in enumerate(groups) for _ in y]
    assert align.alignment(spark, empty, **vocabularies).count() == 0


def test_alignment_of_long_texts(vocabularies):
    """Cutting a text leaves its ids as they are."""
    long = " ".join(odd_texts() + ["plain words follow here"] * 50)
    whole = align.Pieces(vocabularies["model_path"], chunk=1 << 30)
    assert align.Pieces(vocabularies["model_path"], chunk=20).encode(long) == whole.encode(long)


def brute_runs(ws, least=24):
    out = {}
    for q in range(1, len(ws) // 3 + 1):
        i = 0
        while i + q < len(ws):
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 3 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def periodic_words(rng):
    """Words with nested repeats, repeats with an error, and long flat parts."""
    letters = rng.choice([1, 2, 3, 5, 50])

    def part(n, depth):
        if not depth or n < 3:
            return [str(rng.randrange(letters)) for _ in range(n)]
        root = part(rng.randint(1, n // 3 + 1), depth - 1) + ["0"] * rng.choice([0, 0, 7, 30])
        out = root * rng.randint(2, 5) + root[: rng.randrange(len(root))]
        if rng.random() < 0.3:
            out[rng.randrange(len(out))] = "x"
        return out

    out = []
    while len(out) < rng.randint(0, 700):
        out += part(rng.randint(1, 250), rng.randint(0, 3)) + [str(rng.random()) for _ in range(rng.choice([0, 1, 20]))]
    return out[:1200]


def test_periodic_runs(spark, docs, empty):
    rng = random.Random(2)
    rows = [(i, rng.choice([" ", "\n \t"]).join(periodic_words(rng)), "r") for i in range(120)] + [(500, None, ""), (501, " \n", ""), (None, "a " * 30, ""), (502, "a " * 30, ""), (502, "a " * 30, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    found = 0
    got = sorted(((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(frame).collect()), key=repr)
    want = []
    for i, t, _ in rows:
        ws = WORD.findall(t or "")
        runs = brute_runs(ws)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((str(i), len(ws), runs, " ".join(w for k, w in enumerate(ws) if k not in gone)))
        found += len(runs)
    assert got == sorted(want, key=repr) and found > 100
    assert periodic.periodic_runs(empty).count() == 0
    with pytest.raises(ValueError):
        periodic.Finder(repeats=2)


def test_periodic_query(spark, sf):
    """The whole query against brute force, with the planted periods."""
    got = {r.doc_id: r for r in queries.op13_periodic(spark, sf).collect()}
    assert any(r.n_runs for r in got.values())
    for i, t in texts(spark.read.parquet(f"{sf}/documents.parquet")).items():
        ws = WORD.findall(t or "")
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(ws)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [ws[k if k < a else a + (k - a) % p] for k in range(n)]
        runs = brute_runs(ws)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for k, w in enumerate(ws) if k not in gone).encode()).hexdigest()


def test_periodic_hash_collisions(monkeypatch):
    """With hashes of a few bits the check by words still leaves true runs only."""
    plain = periodic.Finder._hash
    monkeypatch.setattr(periodic.Finder, "_hash", lambda self, at, n: plain(self, at, n) & np.uint64(7))
    rng = random.Random(4)
    for _ in range(5):
        ws = periodic_words(rng)
        ids = np.array([hash(w) & 0xFFFFFF for w in ws], np.int64)
        got = [tuple(r[1:]) for r in periodic.Finder()(ids, np.array([0, len(ids)])).tolist()]
        assert set(got) <= set(brute_runs(ids.tolist()))


@pytest.mark.parametrize("name, label", [("op4_toxicity", "toxic"), ("op5_quality", "quality")])
def test_classifiers_beat_the_majority(spark, name, label):
    """On the real labels of the held-out fold, at a size with a handful of the rarer class."""
    sf = "/root/testdata/sf0.01"
    known = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", label)
    rows = queries.Q[name](spark, sf).where("held_out").join(known, "doc_id").where(f"{label} IS NOT NULL").collect()
    wrong = sum(r.predicted != r[label] for r in rows)
    rare = min(sum(r[label] for r in rows), sum(1 - r[label] for r in rows))
    assert rare >= 5 and wrong < rare


def test_class_prior_is_a_lower_bound():
    """Two overlapping clouds with known shares: the bound stays below the truth and comes near it as rows grow."""
    for n, least in ((400, 0.45), (8000, 0.7)):
        r = np.random.default_rng(n)
        positive = r.normal(1, 1, (n // 2, 4))
        unlabelled = np.where(r.random(n)[:, None] < 0.8, r.normal(1, 1, (n, 4)), r.normal(-1.5, 1, (n, 4)))
        assert least < quality.class_prior(positive, unlabelled) < 0.83


def test_gradients_in_parts(monkeypatch):
    """Parts of a batch add up to its gradient."""
    net, r = toxicity.Network(), np.random.default_rng(0)
    samples = [r.integers(1, toxicity.TABLE, (n, 5)).astype(np.int32) for n in (3, 0, 40, 7, 1, 90)]
    labels = np.array([0, 1, 1, 0, 1, 0])
    whole = net.batch_gradients(samples, labels)
    monkeypatch.setattr(toxicity, "PART", 10)
    parts = net.batch_gradients(samples, labels)
    assert all(np.allclose(whole[0][k], parts[0][k], atol=1e-6) for k in whole[0])
    assert (whole[1] == parts[1]).all() and np.allclose(whole[2], parts[2], atol=1e-6)


WORKER = """
import sys
sys.path.insert(0, {repo!r})
from contestry.session import get_spark
from contestry.llm import queries
spark = get_spark("elsewhere", "local[2]", 2)
spark.sparkContext.setLogLevel("ERROR")
for name in ("op4_toxicity", "op5_quality", "op12_alignment", "op13_periodic"):
    print(name, queries.Q[name](spark, {sf!r}).count())
"""


def test_workers_need_no_package(tmp_path, sf):
    """Started from another folder, where workers can't import the package."""
    repo = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "CONTESTRY_SCRATCH")}
    env["PYTHONPATH"] = os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and p != repo)
    done = subprocess.run([sys.executable, "-c", WORKER.format(repo=repo, sf=sf)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert [line.split()[1] for line in done.stdout.splitlines() if line.startswith("op")] == ["200"] * 4


def test_rows_keep_columns_of_any_name(spark, docs, sf):
    """Columns named like the operators' own come through every filtering operator."""
    names = ["_row", "_sha", "_digest", "_id", "_chars", "_n", "_own", "_length", "_gone", "score", "predicted", "label", "digest", "component"]
    table = docs.select("doc_id", "text", *[F.concat(F.lit(f"{n}-"), "doc_id").alias(n) for n in names])
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    repeated = table.union(table.where("doc_id = 903"))
    for kept in (toxicity.keep_rows(spark, table, labels), cuckoo.keep_rows(spark, repeated), minhash.keep_rows(spark, table, size=5)):
        assert kept.columns == table.columns
        rows = kept.collect()
        assert len(rows) > 20 and all(r[n] == f"{n}-{r.doc_id}" for r in rows for n in names if r.doc_id is not None)
    assert cuckoo.keep_rows(spark, repeated).where("doc_id = 903").count() == 1


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """More labelled rows of either class than any earlier bound; shards and the order of the input change nothing."""
    rows = [(i, f"und der w{i % 900} {'scumwort' if i % 2 else 'gutes'} die", i % 2) for i in range(20_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    monkeypatch.setattr(toxicity, "SHARD", 5000)
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    took, train = [], toxicity.train

    def taking(blocks, clean, toxic, seed):
        took.append((blocks.agg(F.sum("n")).first()[0], clean + toxic, blocks.select("shard").distinct().count()))
        return train(blocks, clean, toxic, seed)

    cut = toxicity.thresholds
    monkeypatch.setattr(toxicity, "train", taking)
    monkeypatch.setattr(toxicity, "thresholds", lambda logits: took.append(logits.count()) or cut(logits))
    state = toxicity.fit(table, table.select("doc_id", "toxic"))
    known = table.where(~toxicity.held_out(F.col("doc_id"))).count()
    (n, counted, shards), kept = took
    assert n == counted and n + kept == known > 15_000 and shards == -(-known // 5000) > 1
    assert toxicity.fit(table.repartition(7), table.select("doc_id", "toxic")) == state


def test_toxicity_thresholds(spark):
    """The running counts find the cut that looking at every one finds, with equal logits on one side."""
    r = np.random.default_rng(5)
    rows = [(int(g), round(float(x), 2), int(r.random() < 1 / (1 + np.exp(-x)))) for g, x in zip(r.integers(0, 3, 3000), r.normal(0, 3, 3000), strict=True)]
    rows += [(4, 1.0, 1)] * 20 + [(4, 2.0, 0)] * 20 + [(3, 0.5, 1)] * 4
    got = toxicity.thresholds(spark.createDataFrame(rows, "language int, logit double, label long"))

    def best(own):
        xs = sorted({x for _, x, _ in own})
        edges = [xs[0] - 1, *xs, xs[-1] + 1]
        cuts = [(sum((x > (a + b) / 2) != y for _, x, y in own), a - b if i else -1.0, (a + b) / 2) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
        return min((e, round(gap, 9)) for e, gap, _ in cuts), {round(at, 6): (e, round(gap, 9)) for e, gap, at in cuts}

    for g in range(5):
        least, at = best(rows if g == 3 else [x for x in rows if x[0] == g])
        assert at[round(float(got[g]), 6)] == least
    assert (toxicity.thresholds(spark.createDataFrame([], "language int, logit double, label long")) == 0).all()
