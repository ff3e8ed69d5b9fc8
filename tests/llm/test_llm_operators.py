"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkwright.llm import bpe, chat, components, line_dedup, media, near_dedup, neighbours, packing, quality, substring_dedup, token_store
from linkwright.llm.suffix_array import common_prefixes, suffix_array

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, n int, key string, lines string, doc string, root string, place int, size int, rest int"


def make(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k", "l", "d", "r", 2, 3, 4) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    random.seed(5)
    words = ["alpha", "beta", "gamma,", "delta.", "été", "日本", "x1", "it's", "\n", "  ", "A!"] + [f"w{k}" for k in range(300)]
    body = [" ".join(random.choices(words, k=90)) for _ in range(12)]
    near = [body[0].replace("w1", "zz", 1), body[0] + " tail"]
    return [None, "", "a", "one two three", *body, *near, body[3], " ".join(random.choices(words, k=9000)), body[4] + "\n" + body[5]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = list(enumerate(texts)) + [(5, texts[5]), (None, texts[6])]
    return make(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, [])


def pairs_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def test_suffix_array_against_sorting():
    random.seed(1)
    for _ in range(500):
        s = [random.randint(1, random.choice([1, 2, 9])) for _ in range(random.randint(0, 30))] + [0]
        order = suffix_array(np.array(s))
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        shared = common_prefixes(np.array(s), order)
        for k in range(1, len(s)):
            a, b = s[order[k - 1] :], s[order[k] :]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert shared[k] == n


def test_bpe_equals_the_library(spark, docs, empty):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.BytePairCodec(ranks, public_tokenizers.PATTERN, cache_entries=50)
    random.seed(2)
    for _ in range(400):
        t = "".join(random.choices(["a", "é", "日", " ", "  ", "\n", "'s", "12", "!", "the", "　", "😀", "zq"], k=random.randint(0, 30)))
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == library.encode_ordinary(t)
        assert codec.decode(codec.encode(t)).decode() == t
    found = bpe.encode_decode(docs, path, public_tokenizers.PATTERN)
    wanted = sorted((str(i), hashlib.sha256(np.array(library.encode_ordinary(t), "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in pairs_of(docs))
    assert sorted((str(r["doc_id"]), r["ids_sha256"], r["decoded_sha256"]) for r in found.collect()) == wanted
    assert bpe.encode_decode(empty, path, public_tokenizers.PATTERN).count() == 0


def test_line_dedup(spark, empty):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "a\nb"), (4, None), (5, ""), (6, "\n\n\n\n\n"), (7, "q\nq\nq\nq"), (2, "x\na\nb\nc\ny"), (8, "b\nc\nd\ne\nf")]
    found = line_dedup.dedup_lines(make(spark, rows), with_counts=True)
    got = {(r["doc_id"], r["text"], r["n_removed"]) for r in found.collect()}
    assert got == {(1, "a\nb\nc\nd", 0), (2, "x\ny", 3), (3, "a\nb", 0), (4, None, 0), (5, "", 0), (6, "\n\n\n\n\n", 0), (7, "q", 3), (8, "e\nf", 3)}
    assert found.columns[: len(empty.columns)] == empty.columns
    assert line_dedup.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("block_queries", [neighbours.BLOCK_QUERIES, 3])
def test_neighbours(spark, monkeypatch, block_queries):
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", block_queries)
    random.seed(4)
    rows = [(i, [random.gauss(0, 1) for _ in range(8)]) for i in range(600)]
    rows += [(1000 + i, [1.0] * 8) for i in range(40)] + [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [1.0, None] * 4), (2004, [1.0] * 3), (None, [1.0] * 8)]
    rows += [(1050, [1.0] * 7 + [1.5])] * 2  # repeated ids count as separate rows, but never as their own neighbours
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("h", F.lit(1)).withColumn("leaf", F.lit(2))
    found = neighbours.search(df, F.col("id") % 50 == 0, recall=0.97, sample=200, block_rows=32).collect()
    sound = [(i, np.array(v)) for i, v in rows if i is not None and i < 2000]
    ids, v = np.array([i for i, _ in sound]), np.array([x for _, x in sound])
    by = defaultdict(list)
    for r in sorted(found, key=lambda r: r["rank"]):
        by[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    queries = [i for i in ids.tolist() if i % 50 == 0]
    for q in queries:
        scores = neighbours._cosines(v[ids == q][0], v)
        scores[ids == q] = -9
        best = ids[np.lexsort((ids, -scores))[:5]].tolist()
        hits += len(set(best) & {i for i, _ in by[q]})
        assert all(s == scores[ids == i][0] for i, s in by[q]) and len(by[q]) == 5
    assert hits / (5 * len(queries)) >= 0.9
    assert [i for i, _ in by[1000]] == [1001, 1002, 1003, 1004, 1005]
    assert neighbours.search(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_chat(spark):
    turns = [
        (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "yes"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "no"),
        (2, "chosen", 0, "user", None), (3, "chosen", 0, "user", "same"), (3, "rejected", 0, "user", "same"), (None, "chosen", 0, "user", "x"), (4, "other", 0, "user", "x"),
    ]
    found = {r["pair_id"]: r for r in chat.format_preferences(spark.createDataFrame(turns, "pair_id long, side string, turn long, role string, text string")).collect()}
    assert set(found) == {1, 2, 3}
    one = found[1]
    assert (one["common_turns"], one["prompt"]) == (1, "<|user|>\nhi<|end|>\n")
    a, b = map(int, one["chosen_mask"].split("-"))
    assert one["chosen"][a:b] == "yes<|end|>\n" and one["rejected_trained"] == len("no<|end|>\n")
    assert (found[2]["prompt"], found[2]["chosen"], found[2]["rejected"]) == ("", "<|user|>\n<|end|>\n", "")
    assert (found[3]["chosen"], found[3]["rejected"], found[3]["chosen_mask"]) == ("", "", "")


def test_chat_with_ties_repeats_and_long_texts(spark):
    """Tied turn numbers, repeated rows, long texts and empty tables against plain Python."""
    rng = random.Random(19)
    schema = "pair_id long, side string, turn long, role string, text string, chosen string, k int, first int"
    turns, long = [], "word " * 200_000
    for pair in range(30):
        shared = [(t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, long if pair == 3 else "c"])) for t in range(rng.randint(0, 4))]
        for side in ("chosen", "rejected"):
            own = [(rng.choice([None, 5, 5, 6]), rng.choice(["user", "assistant"]), rng.choice("xyz")) for _ in range(rng.randint(0, 3))]
            for turn, role, text in shared + own + own[:1]:
                turns.append((pair, side, turn, role, text, "c", 1, 2))
    df = spark.createDataFrame(turns, schema)
    assert chat.format_preferences(df.limit(0)).count() == 0
    found = {r["pair_id"]: r for r in chat.format_preferences(df).collect()}
    for pair in range(30):
        sides = []
        for side in ("chosen", "rejected"):
            own = [(t, r or "", x or "") for p, s, t, r, x, *_ in turns if (p, s) == (pair, side)]
            sides.append([(r, x) for _, r, x in sorted(own, key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))])
        if not any(sides):
            assert pair not in found
            continue
        common = 0
        while common < min(map(len, sides)) and sides[0][common] == sides[1][common]:
            common += 1
        render = lambda ts: "".join(f"<|{r}|>\n{x}<|end|>\n" for r, x in ts)
        r = found[pair]
        assert (r["common_turns"], r["prompt"]) == (common, render(sides[0][:common]))
        for name, ts in zip(("chosen", "rejected"), sides):
            assert r[name] == render(ts[common:])
            spans = [tuple(map(int, m.split("-"))) for m in r[f"{name}_mask"].split(",") if m]
            assert [r[name][a:b] for a, b in spans] == [f"{x}<|end|>\n" for role, x in ts[common:] if role == "assistant"]
            assert r[f"{name}_trained"] == sum(b - a for a, b in spans)


def test_media_forms_and_features(spark, docs):
    """The stored form by the tarfile module and an own decoder; features by definition."""
    import io
    import tarfile

    from linkwright.llm.shared import open_store

    index = media.add_features(media.write_media(docs)).collect()
    texts = {hashlib.sha256(media.payload_of(t)).hexdigest(): media.payload_of(t) for _, t in pairs_of(docs)}
    assert {r["digest"] for r in index} == set(texts)
    for r in index:
        store, path = open_store(r["shard"])
        with store.open_input_file(path) as f:
            shard = f.read()
        member = next(m for m in tarfile.open(fileobj=io.BytesIO(shard)).getmembers() if m.name == f"{r['digest']}.png")
        image = shard[member.offset_data : member.offset_data + member.size]
        assert (member.offset_data, member.size) == (r["offset"], r["length"])
        assert (len(image), hashlib.sha256(image).hexdigest()) == (r["media_bytes"], r["media_sha256"])
        data = zlib.decompress(image[image.index(b"IDAT") + 4 : image.index(b"IEND") - 8])
        payload = b"".join(data[k + 1 : k + 577] for k in range(0, len(data), 577))
        assert payload == texts[r["digest"]] and image[24:26] == b"\x08\x00"  # eight bits, grey
        x = np.frombuffer(payload, dtype=np.uint8).astype(float)
        share = np.unique(x, return_counts=True)[1] / len(x)
        bits = np.packbits([s.mean() >= x.mean() for s in x.reshape(64, -1)]).tobytes().hex()
        mean, deviation, entropy, pattern = r["feature"].split(",")
        assert np.allclose([float(mean), float(deviation), float(entropy)], [x.mean(), x.std(), -(share * np.log2(share)).sum()], atol=2e-6) and pattern == bits


def test_boundaries_are_optimal():
    from itertools import combinations

    random.seed(6)
    for _ in range(40):
        lengths = sorted(random.sample(range(1, 60), 8))
        cells = [(n, c := random.randint(1, 9), n * c, n) for n in lengths]
        cost = lambda tops: sum(c * min(t for t in tops if t >= n) for n, c, _, _ in cells)  # noqa: E731, B023
        best = min(cost([*x, lengths[-1]]) for k in range(3) for x in combinations(lengths[:-1], k))
        assert cost(packing.choose_boundaries(cells, 3)) == best


def test_boundaries_of_long_texts_are_optimal(spark):
    """Lengths above 511 words, where neighbouring lengths must not be taken together."""
    from itertools import combinations

    lengths, counts = [700, 1001, 1002, 1010, 5001, 5002, 5003, 5017, 5018], [3, 90, 1, 4, 60, 1, 2, 80, 1]
    cost = lambda tops: sum(c * (min(t for t in tops if t >= n) - n) for n, c in zip(lengths, counts))
    best = min(cost([*x, lengths[-1]]) for x in combinations(lengths[:-1], 3))
    rows = [n for n, c in zip(lengths, counts) for _ in range(c)]
    placed = packing.assign_batches(spark.createDataFrame(list(enumerate(rows)), "doc_id long, n_tokens long"), buckets=4)
    assert placed.agg(F.sum("padding")).first()[0] == best


def test_boundaries_of_many_lengths():
    """Against the plain programme over every cut."""
    rng = np.random.default_rng(3)
    for n, buckets in ((1, 3), (2, 3), (60, 1), (200, 7), (300, 12)):
        lengths = np.sort(rng.choice(30_000, n, replace=False))
        counts = rng.integers(1, 1 + 50 * rng.integers(1, 5, n) ** 3)
        rows = np.concatenate([[0], np.cumsum(counts)])
        cost = np.where(np.arange(n + 1), np.inf, 0.0)
        for _ in range(min(buckets, n)):
            cost = np.array([0.0] + [(cost[:j] + (rows[j] - rows[:j]) * lengths[j - 1]).min() for j in range(1, n + 1)])
        tops = np.array(packing.choose_boundaries([(int(x), int(c), int(x * c), int(x)) for x, c in zip(lengths, counts)], buckets))
        assert (tops[np.searchsorted(tops, lengths)] * counts).sum() == cost[n]


def test_packing(spark, docs, empty):
    found = packing.pack_documents(docs, buckets=3, token_budget=400, slice_rows=4).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in found) == sorted((str(i), len(t.split())) for i, t in pairs_of(docs))
    batches = defaultdict(list)
    for r in found:
        assert r["padding"] == r["bucket_len"] - r["n_tokens"] >= 0
        batches[r["bucket"], r["batch"]].append(r)
    for rows in batches.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
        assert len(rows) == 1 or len(rows) * rows[0]["bucket_len"] <= 400
    assert packing.pack_documents(empty).count() == 0


def test_media(spark, docs, empty):
    index = media.write_media(docs)
    assert index.groupBy("digest").count().where("count > 1").count() == 0
    rows = media.media_rows(docs, media.add_features(index)).collect()
    wanted = sorted((str(i), len(t.encode()), hashlib.sha256(media.payload_of(t)).hexdigest(), zlib.crc32(media.payload_of(t)[-32:])) for i, t in pairs_of(docs))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == wanted
    assert all(r["digest"] == r["payload_sha256"] for r in rows)
    heights = {r["digest"]: r["height"] for r in media.add_metadata(index).collect()}
    assert all(heights[r["digest"]] * media.LINE == r["payload_bytes"] for r in rows)
    assert media.write_media(empty).count() == 0


def _shingles(t):
    w = tuple(t.encode().lower().split())
    return frozenset(w[i : i + 5] for i in range(max(len(w) - 4, 1))) if w else frozenset()


def test_near_duplicates(spark, docs, empty):
    rows = pairs_of(docs)
    sets = [_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            groups[find(i)].append(d)
    wanted = sorted(
        (str(d), len(sets[i]), str(min(groups[find(i)], default=None)) if sets[i] else str(d)) for i, (d, _) in enumerate(rows)
    )
    found = near_dedup.near_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in found) == wanted
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert near_dedup.near_duplicates(empty).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5)], "a long, b long")
    found = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7}


def _span_rows(spark, texts, **options):
    """For each text, the bytes that the operator covers, by kind."""
    df = make(spark, list(enumerate(texts)))
    spans = {(r["key"], r["size"]): r["spans"] for r in substring_dedup.repeated_spans(df, **options).collect()}
    out = []
    for r, t in zip(substring_dedup.keyed(df, "text").collect(), texts):
        have = np.zeros((2, len((t or "").encode())), dtype=bool)
        for s in spans.get((r["key"], r["size"]), []):
            have[s["kind"], s["a"] : s["b"]] = True
        out.append(have)
    return out


def _wanted_rows(texts, length, words):
    """The same by brute force: every window of bytes, and every window of words, trimmed and shorter than ``length``."""
    count, places = defaultdict(int), []
    for t in texts:
        b = (t or "").encode()
        own = [(0, i, i + length) for i in range(len(b) - length + 1)]
        ends = []
        for m in re.finditer(rb"[^ \t\n\v\f\r]+", b):
            x, y = m.span()
            letters = [k for k in range(x, y) if b[k] >= 128 or chr(b[k]).isalnum()]
            ends.append((letters[0], letters[-1] + 1) if letters else (x, y))
        own += [(1, ends[i][0], ends[i + words - 1][1]) for i in range(len(ends) - words + 1) if words]
        own = [w for w in own if w[0] == 0 or w[2] - w[1] < length]
        for kind, x, y in own:
            count[kind, b[x:y]] += 1
        places.append((b, own))
    out = []
    for b, own in places:
        want = np.zeros((2, len(b)), dtype=bool)
        for kind, x, y in own:
            if count[kind, b[x:y]] > 1:
                want[kind, x:y] = True
        out.append(want)
    return out


@pytest.mark.parametrize("group", [substring_dedup.GROUP, 1])
def test_substrings(spark, group):
    random.seed(8)
    fill = lambda n: "".join(random.choices("abcdefgh é", k=n))
    passage, other = fill(500), fill(450)
    texts = [fill(300) + passage + fill(100), passage + fill(700), None, "", fill(399), fill(900), other + fill(30) + other, "ab" * 600, fill(80) + passage[20:480] + fill(90)]
    texts += [texts[5], "x" * 900, "." * 700 + "q" + "-" * 30 + "y" * 380, " " * 800, "z" * 40 + "." * 700 + "r" + "-" * 30 + "y" * 380]
    for have, want in zip(_span_rows(spark, texts, group=group), _wanted_rows(texts, 400, 0)):
        assert (have == want).all()
    if group > 1:
        df = make(spark, list(enumerate(texts)))
        kept = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(df).collect()}
        assert kept[2] is None and kept[3] == "" and kept[5] == kept[9] == "" and kept[4] == texts[4]
        assert substring_dedup.substring_report(df.limit(0)).count() == 0


def test_substrings_large_groups_fetch_texts_once(spark, monkeypatch):
    """Groups of both kinds, settled from one shuffle of the texts."""
    random.seed(6)
    text = lambda: "".join(random.choices("abcdefghij ", k=500))
    common, pair = text(), text()
    texts = [text() + common + text() for _ in range(4)] + [text() + pair + text() for _ in range(2)] + [text()]
    calls, ways, fetch, match, oversized = [], set(), substring_dedup.fetch, substring_dedup.match_groups, substring_dedup.oversized
    monkeypatch.setattr(substring_dedup, "fetch", lambda *a: (calls.append(1), fetch(*a))[1])
    monkeypatch.setattr(substring_dedup, "match_groups", lambda df, *a: (ways.add(("small", df.count() > 0)), match(df, *a))[1])
    monkeypatch.setattr(substring_dedup, "oversized", lambda df, *a: (ways.add(("large", df.count() > 0)), oversized(df, *a))[1])
    for have, want in zip(_span_rows(spark, texts, group=2), _wanted_rows(texts, 400, 0)):
        assert (have == want).all()
    assert ways == {("small", True), ("large", True)}
    assert len(calls) == 1


@pytest.mark.parametrize("group", [substring_dedup.GROUP, 1])
def test_substrings_of_words(spark, group):
    """Passages of over 50 words under 400 bytes; those of 50 words and shorter ones stay."""
    random.seed(11)
    word = lambda: "".join(random.choices("abcdefgh", k=random.randint(1, 8))) + random.choice(["", "", "", "é", ","])
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, fifty, tiny, long = prose(51).strip(","), prose(50).strip(","), " ".join("a" * 51), prose(90).strip(",")
    assert len(passage.encode()) < 400 and len(tiny) == 101
    texts = [
        prose(30) + " " + passage + " " + prose(20), prose(9) + "\n(" + passage + ").\n" + prose(70), prose(60) + " " + fifty + " " + prose(9), fifty + " " + prose(80),
        tiny, prose(3) + " " + tiny + "\t" + prose(4), None, "", prose(200), long + " " + prose(5), prose(5) + " " + long, prose(8) + " " + long[20:-20] + " " + prose(3),
        passage + " " + prose(12), prose(4) + " " + fifty + "x " + prose(70),
    ]
    texts += [texts[8]]
    for have, want in zip(_span_rows(spark, texts, group=group, rule=substring_dedup.Rule(words=51)), _wanted_rows(texts, 400, 51)):
        assert (have == want).all()
    if group > 1:
        df = make(spark, list(enumerate(texts))).withColumn("cut_key", F.lit(1)).withColumn("cut_text_", F.lit(2))
        found = substring_dedup.remove_repeats(df, words=51)
        kept = {r["doc_id"]: r["text"] for r in found.collect()}
        assert found.columns == df.columns
        assert kept[0] == texts[0].replace(passage, "") and kept[1] == texts[1].replace(passage, "") and kept[4] == kept[8] == ""
        assert [kept[k] for k in (2, 3, 6, 7, 13)] == [texts[k] for k in (2, 3, 6, 7, 13)]
        assert long[20:-20] not in kept[9] and long[20:-20] not in kept[11]
        report = {r["doc_id"]: r for r in substring_dedup.substring_report(make(spark, list(enumerate(texts)))).collect()}
        for k, (t, want) in enumerate(zip(texts, _wanted_rows(texts, 400, 51))):
            b = np.frombuffer((t or "").encode(), dtype=np.uint8)
            r = report[k]
            runs = int((np.diff(np.concatenate([[0], want[0].astype(int)])) == 1).sum())
            assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(b), int(want[0].sum()), runs)
            assert r["kept_sha256"] == hashlib.sha256(b[~want[0]].tobytes()).hexdigest()
            assert r["text"] == b[~want.any(axis=0)].tobytes().decode("utf-8", "ignore") and r["n_kept"] == len(r["text"].encode())


def test_substrings_of_a_long_text(spark):
    """A text of several segments, with repeats across their borders and in itself."""
    rng = random.Random(23)
    size = substring_dedup.SEGMENT
    fill = lambda n: "".join(rng.choices("abcdefgh      ", k=n))
    passage, other = fill(900), fill(450)
    long = bytearray(fill(2 * size + 5000).encode())
    places = [(size - 300, passage), (2 * size - 450, other), (77, other)]
    for at, text in places:
        long[at : at + len(text)] = text.encode()
    texts = [bytes(long).decode(), fill(50) + "|" + passage + "|" + fill(50)]
    have = [h[0] for h in _span_rows(spark, texts)]
    want = np.zeros(len(long), dtype=bool)
    for at, text in places:
        want[at : at + len(text)] = True
    assert abs(int(have[0].sum()) - int(want.sum())) <= 12 and not (want & ~have[0]).any()  # chance may lengthen a match by a byte or two
    assert have[1][51:951].all() and have[1].sum() <= 904


def _mutated(rng, passage):
    """A passage with a few bytes changed, cut at both ends."""
    x, y = sorted(rng.sample(range(len(passage)), 2))
    part = list(passage[x:y])
    for _ in range(rng.randint(0, 3)):
        if part:
            part[rng.randrange(len(part))] = rng.choice("ab ")
    return "".join(part)


def _covered(texts, rule):
    """What one task would find, with the contexts of all anchors in one suffix array for each side."""
    have = [np.zeros((2, len(t.encode())), dtype=bool) for t in texts]
    rows = sorted((int(f), int(c), k, *map(int, rest)) for k, t in enumerate(texts) for f, c, *rest in zip(*substring_dedup.contexts(t.encode(), rule)))
    times = Counter(r[:2] for r in rows)
    for _, _, k, a, b, first, last, _ in (r for r in rows if times[r[:2]] > 1):
        have[k][0, a : b if b - a >= rule.length else a] = True
        have[k][1, a + first : a + last] = True
    rows = list({r[:2]: r for r in rows}.values())
    parts = [texts[r[2]].encode()[r[3] : r[4]] for r in rows]
    first, last, at = (np.array([r[k] for r in rows], dtype=np.int64) for k in (5, 6, 7))
    for n, a, b, kind in zip(*(x.tolist() for x in substring_dedup.match_contexts(parts, at, first, last, rule))):
        have[rows[n][2]][kind, rows[n][3] + a : rows[n][3] + b] = True
    return have


@pytest.mark.parametrize(("length", "words"), [(80, 13), (64, 0), (120, 20), (120, 40), (400, 51)])
def test_matching_of_contexts(length, words):
    """Texts with many copies and near copies against comparing all windows; the suffix array decides, so a wrong one shows."""
    rng = random.Random(17)
    rule = substring_dedup.Rule(length, words)
    wrong = 0
    for turn in range(12):
        alphabet = ["ab ", "abcdefgh    .", "a", "a ."][turn % 4]
        fill = lambda low, high: "".join(rng.choices(alphabet, k=rng.randint(low, high)))  # noqa: E731, B023
        passages = [fill(60, 5 * length) for _ in range(3)]
        texts = [fill(0, 90) + _mutated(rng, rng.choice(passages)) + fill(0, 90) for _ in range(14)]
        want = _wanted_rows(texts, length, words)
        assert all((a == b).all() for a, b in zip(_covered(texts, rule), want))
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(substring_dedup, "suffix_array", lambda s: np.arange(len(s))[::-1])
            wrong += any((a != b).any() for a, b in zip(_covered(texts, rule), want))
    assert wrong > 2


def test_byte_order():
    rng = random.Random(3)
    for alphabet in ("ab", "abcdefgh ", "a"):
        strings = ["".join(rng.choices(alphabet, k=rng.randint(1, 300))).encode() for _ in range(40)]
        strings += [s[:k] + rng.choice(strings)[:k] for s in strings[:30] for k in (20, 150)] + strings[:5]
        place, common = substring_dedup.byte_order(strings)
        ordered = sorted(set(strings))
        assert [ordered[k] for k in place.tolist()] == strings
        assert common.tolist() == [0] + [len(os.path.commonprefix([a, b])) for a, b in zip(ordered, ordered[1:])]


def test_windows_belong_to_one_context(monkeypatch):
    """Every window lies in a context, across segments, and equal windows have equal anchors."""
    rng = random.Random(12)
    rule = substring_dedup.Rule(words=51)
    prose = lambda n: " ".join("".join(rng.choices("abcd.", k=rng.randint(1, 9))) for _ in range(n))
    shared = prose(400)
    for size in (1 << 19, 1000):
        monkeypatch.setattr(substring_dedup, "SEGMENT", size)
        anchors = defaultdict(set)
        for text in (prose(900) + " " + shared + " " + prose(80), prose(100) + "\n" + shared[3:] + prose(100), "-" * 3000 + shared):
            data = text.encode()
            f, _, starts, ends, first, last, _ = substring_dedup.contexts(data, rule)
            spans, hold = _wanted_places(data, rule), defaultdict(set)
            for k, (x, y) in enumerate(zip(starts.tolist(), ends.tolist())):
                part = [data[x:y]]
                a, b = substring_dedup.all_windows(part, first[k : k + 1], last[k : k + 1], np.array([0, y - x]), rule)
                for w in zip((a + x).tolist(), (b + x).tolist()):
                    hold[w].add(int(f[k]))
            assert set(hold) == spans
            for (x, y), own in hold.items():
                anchors[data[x:y]].add(frozenset(own))
        assert all(frozenset.intersection(*own) for own in anchors.values())


def _wanted_places(data, rule):
    ends = []
    for m in re.finditer(rb"[^ \t\n\v\f\r]+", data):
        x, y = m.span()
        letters = [k for k in range(x, y) if data[k] >= 128 or chr(data[k]).isalnum()]
        ends.append((letters[0], letters[-1] + 1) if letters else (x, y))
    found = {(i, i + rule.length) for i in range(len(data) - rule.length + 1)}
    return found | {(ends[i][0], ends[i + 50][1]) for i in range(len(ends) - 50) if ends[i + 50][1] - ends[i][0] < rule.length}


def test_quality(spark, empty):
    random.seed(9)
    good, bad = [f"g{k}" for k in range(80)], [f"b{k}!!" for k in range(80)]
    rows = [(i, " ".join(random.choices(bad if i % 5 == 0 else good, k=40))) for i in range(400)] + [(400, None), (401, ""), (7, "g1 g2")]
    labels = spark.createDataFrame([(i, 0 if i % 5 == 0 else 1) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, quality int")
    found = {r["doc_id"]: r for r in quality.resample(make(spark, rows), labels).collect()}
    assert all(found[i]["kept"] == (i % 5 != 0) for i in range(200, 400)) and found[400]["log_weight"] == 0
    assert quality.select_rows(make(spark, rows), labels).columns == empty.columns
    assert quality.resample(empty, labels).count() == 0
    values = [random.choice([1.0, 2.5, -3.0, random.random()]) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 7, 150, 300):
        assert quality.kth_largest(df, "v", k, bins=4, last=5) == sorted(values, reverse=True)[k - 1]


def test_quality_by_brute_force(spark):
    """Counts, log weights, keys, k and decisions against plain Python; a row's noise is Spark's hash of its id."""
    rng = random.Random(21)
    good, bad = [f"g{k}" for k in range(60)] + ["the", "É"], [f"b{k}!!" for k in range(60)] + ["the"]
    rows = [(i, " ".join(rng.choices(bad if i % 4 == 0 else good, k=rng.randint(0, 12)))) for i in range(300)] + [(300, None), (7, "g1 g2"), (None, "g3 the")]
    labels = [(i, 0 if i % 4 == 0 else 1) for i in range(0, 240, 2)] + [(9, 1), (9, 0), (None, 1), (11, None)]
    docs, wide = make(spark, rows), 1 << 64

    def bag(text):
        hashes = [zlib.crc32(t.encode()) for t in re.findall(r"\w+|[^\w\s]+", (text or "").lower())]
        ones = [(h * 0x9E3779B97F4A7C15 % wide) >> 40 for h in hashes]
        twos = [((a * 0x9E3779B97F4A7C15 + b) * 0x9E3779B97F4A7C15 % wide) >> 40 for a, b in zip(hashes, hashes[1:])]
        return [x % quality.BUCKETS for x in ones + twos]

    sound = defaultdict(list)
    for i, y in labels:
        if i is not None and y is not None:
            sound[i].append(y)
    sample = {i: min(y) for i, y in sound.items()}
    ids = sorted(sample)
    target_ids, held = {i for i in ids[::2] if sample[i] > 0}, {i: sample[i] for i in ids[1::2]}
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(bag(t))
        if i in target_ids:
            target.update(bag(t))
    n_raw, n_target, b = sum(raw.values()), sum(target.values()), quality.BUCKETS
    prior = 0.02 * n_target
    ratio = lambda x: np.log((target[x] + prior * raw[x] / n_raw + 0.5) / (n_target + prior + 0.5 * b)) - np.log((raw[x] + 0.5) / (n_raw + 0.5 * b))
    weights = [sum(map(ratio, bag(t))) for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, weights):
        first.setdefault(i, w)
    found = quality.resample(docs, spark.createDataFrame(labels, "doc_id long, quality int"), temperature=2.0).collect()
    unit = {r[0]: (r[1] + 0.5) / (1 << 53) for r in docs.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(quality.SEED)), 11)).collect()}
    cuts = sorted({first[i] for i in held if i in first})
    cuts = [cuts[0] - 1, *((x + y) / 2 for x, y in zip(cuts, cuts[1:]))]
    of = lambda kind: [first[i] for i, y in held.items() if (y > 0) == kind]
    loss = lambda cut: 2 * sum(w <= cut for w in of(True)) / len(of(True)) + sum(w > cut for w in of(False)) / len(of(False))
    k = sum(w > min(cuts, key=loss) for w in weights)
    keys = [w / 2.0 - np.log(-np.log(unit[i])) for (i, _), w in zip(rows, weights)]
    least = sorted(keys, reverse=True)[k - 1]
    wanted = sorted((str(i), len(bag(t)), round(w, 6), round(key, 6), key >= least) for (i, t), w, key in zip(rows, weights, keys))
    assert sorted((str(r["doc_id"]), r["n_grams"], round(r["log_weight"], 6), round(r["key"], 6), r["kept"]) for r in found) == wanted
    assert 0 < k < len(rows)


def test_columns_that_clash(spark):
    """Names that the operators use inside may be columns of the documents."""
    rows = [(i, f"word{i} " * 30) for i in range(6)] + [(6, "word1 " * 30)]
    names = ["kept_row", "drawn_id", "cut_key", "cut_size", "cut_spans", "cut_text", "cut_any", "row", "node", "root", "id", "spans"]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n in names:
        df = df.withColumn(n, F.lit("x"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    for out in (near_dedup.keep_one(df), substring_dedup.remove_repeats(df, words=51), quality.select_rows(df, labels), line_dedup.dedup_lines(df)):
        assert out.columns == df.columns
        assert {tuple(r[n] for n in names) for r in out.collect()} == {("x",) * len(names)}


def test_distance_of_signatures(spark):
    """All pairs at ``LIMIT`` differing symbols or fewer are candidates, none beyond; blocks of any size."""
    rng = np.random.default_rng(4)
    rows, wanted = [], set()
    for number in range(400):
        base = rng.integers(0, 1 << 32, near_dedup.SYMBOLS, dtype=np.uint32)
        changed, k = base.copy(), number % (near_dedup.SYMBOLS + 1)
        changed[rng.choice(near_dedup.SYMBOLS, k, replace=False)] ^= np.uint32(1 + number)
        nodes = [b"a%05d" % number, b"b%05d" % number]
        rows += [(n, 100, s.astype("<u4").tobytes(), bytes(near_dedup.SKETCH)) for n, s in zip(nodes, (base, changed))]
        if k <= near_dedup.LIMIT:
            wanted.add(tuple(nodes))
    classes = spark.createDataFrame(rows, "node binary, n long, signature binary, sketch binary")
    found = near_dedup.propose(near_dedup.bucket_rows(classes)).collect()
    assert {(bytes(r["a"]), bytes(r["b"])) for r in found} == wanted


def test_near_duplicates_in_small_blocks(spark, docs, empty, monkeypatch):
    """Buckets and components that are dealt in blocks give the same rows; a chain of near copies hangs together."""
    rng = random.Random(31)
    words = [f"v{k}" for k in range(200)]
    texts, last = [], rng.choices(words, k=200)
    for k in range(60):
        last = list(last)
        last[(k * 31) % 200] = f"new{k}"
        texts.append(" ".join(last))
    rng.shuffle(texts)
    texts += [" ".join(rng.choices(words, k=60)) for _ in range(10)] + texts[:7]
    df = make(spark, list(enumerate(texts))).repartition(5)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "COMPARE_BLOCK", 3)
    sets = [_shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df).collect()}
    assert found == {i: find(i) for i in range(len(texts))}
    assert len(set(found.values())) < 40


def test_token_store(spark, docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    manifest = token_store.write_tokens(docs, path, shards=3, file_ids=2000)
    found = token_store.read_tokens(manifest).collect()
    wanted = sorted((str(i), len(ids := library.encode(t, add_special_tokens=False).ids + [0]), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in pairs_of(docs))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in found) == wanted
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ordered = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert ordered == sorted(ordered)
    assert token_store.read_tokens(token_store.write_tokens(empty, path)).count() == 0


def test_chunked_encoding_equals_the_library():
    """Spaces, line feeds, marks and the added token in every order; a cache that overflows all the time."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), token_store.LibraryEncoder(open(path).read(), cache_entries=50)
    random.seed(2)
    pieces = ["a", "é", "日", " ", " ", " ", "the", "the", "  ", "\n", "\n", "'s", "12", "!", "...", "'", "　", "😀", "zq", "&&&", "\r", "_", "-", "<|endoftext|>"]
    texts = ["hello <|endoftext|> world", "", " ", "\n", "a ", "a\n", "\na"] + ["".join(random.choices(pieces, k=random.randint(0, 30))) for _ in range(3000)]
    for first in range(0, len(texts), 100):
        part = texts[first : first + 100]
        for text, ids in zip(part, encoder.encode_all(part)):
            assert np.frombuffer(ids, encoder.width).tolist() == library.encode(text, add_special_tokens=False).ids
    (long,) = encoder.encode_all([("the " + "zq, " * 5 + "a\n") * 60_000])
    assert np.frombuffer(long, encoder.width).tolist() == library.encode(("the " + "zq, " * 5 + "a\n") * 60_000, add_special_tokens=False).ids


def test_addressable_codes():
    random.seed(3)
    for high in (1, 200, 70_000, 1 << 31):
        ids = np.array([random.randrange(high) for _ in range(3000)], dtype=np.uint32)
        levels = token_store.build_levels(ids)
        assert (token_store.read_ids(levels, 0, len(ids)) == ids).all()
        for i in random.sample(range(3000), 50):
            assert token_store.read_ids(levels, i, 1)[0] == ids[i]
        assert (token_store.read_ids(levels, 513, 77) == ids[513:590]).all()
