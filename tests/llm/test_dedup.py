"""Near duplicates and repeated substrings against brute force."""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np

from colloquy.llm import neardup, repeats

#: More stages than near duplicates take; each deals its rows out to as many tasks as the session has partitions.
STAGES = 175


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def classes(texts):
    sets, owner = {i: shingle_set(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while owner[x] != x:
            x = owner[x]
        return x

    for a, b in combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            owner[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in texts}


def kept_bytes(texts, length=repeats.LENGTH):
    seen, found = set(), {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        cover = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            window = raw[s : s + length]
            if window in seen:
                cover[s : s + length] = True
            seen.add(window)
        runs = int(np.sum(np.diff(np.concatenate([[0], cover.astype(int)])) == 1))
        found[i] = (len(raw), int(cover.sum()), runs, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~cover])).hexdigest())
    return found


def test_near_duplicates_equal_brute_force(docs, texts):
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    assert found == classes(texts)


def test_pairs_with_a_pivot_are_judged_once(spark):
    rows = [(k, r, 10, [r] * 8, p) for k, members in ((1, (1, 2, 3)), (2, (4, 5))) for r, p in zip(members, (9, 5, 5), strict=False)]
    buckets = spark.createDataFrame([(k, r, n, s, p, 3 if k == 1 else 2) for k, r, n, s, p in rows], "key long, rep long, n long, sketch array<long>, popularity long, many long")
    found = neardup.by_pivot(buckets, 75).select("key", "rep", "many").collect()
    assert sorted(map(tuple, found)) == [(1, 2, 3), (1, 3, 3), (2, 5, 2)]


def test_near_duplicates_take_few_stages(spark, docs):
    spark.sparkContext.setJobGroup("near duplicates", "")
    try:
        assert neardup.near_duplicates(docs).count()
        tracker = spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("near duplicates") for s in tracker.getJobInfo(j).stageIds}
        assert len(stages) < STAGES, len(stages)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_near_duplicates_of_nothing(empty):
    assert neardup.near_duplicates(empty).count() == 0


def test_repeats_equal_brute_force(docs, texts):
    found = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in repeats.remove_repeats(docs).collect()}
    assert found == kept_bytes(texts)


def test_repeats_keep_other_columns(docs):
    row = repeats.remove_repeats(docs).where("doc_id = 6").first()
    assert row.rest.rest == "clash" and row.rest.size == 1


def test_repeats_of_nothing_and_of_repeated_rows(spark, empty):
    assert repeats.remove_repeats(empty).count() == 0
    twice = spark.createDataFrame([(1, "q" * 40 + "xyz" * 50), (1, "q" * 40 + "xyz" * 50)], "doc_id long, text string")
    a, b = repeats.remove_repeats(twice).collect()
    assert a == b and a.n_removed == kept_bytes({1: "q" * 40 + "xyz" * 50})[1][1]


def test_long_text_is_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 500)
    data = np.frombuffer(("abcdefghij" * 300 + "k" * 300).encode(), np.uint8)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([3]), pa.array([data.tobytes().decode()])], ["doc_id", "text"])
    rows = pa.Table.from_batches(list(repeats._initial([batch])))
    blocks = [p for p in rows["place"].to_pylist() if not p & repeats.REMOVED]
    assert max(p >> 16 for p in blocks) <= len(data) - repeats.LENGTH and rows.num_rows > 3


def test_odd_sketch_estimates_similarity():
    random = np.random.default_rng(5)
    for share in (0.75, 0.9):
        a = random.integers(0, 1 << 63, (200, neardup.MINHASHES), dtype=np.uint64)
        b = np.where(random.random(a.shape) < share, a, random.integers(0, 1 << 63, a.shape, dtype=np.uint64))
        differ = np.unpackbits((neardup.odd_sketch(a) ^ neardup.odd_sketch(b)).view(np.uint8), axis=1).sum(axis=1)
        estimate = 1 + np.log(1 - 2 * differ / neardup.SKETCH_BITS) * neardup.SKETCH_BITS / (4 * neardup.MINHASHES)
        assert abs(estimate.mean() - share) < 0.02 and (estimate > neardup.SKETCH_FLOOR).all()


def sketch_loss(share, floor=None):
    """Exact probability that two documents of this similarity get an estimate below the floor."""
    floor = neardup.SKETCH_FLOOR if floor is None else floor
    bits, n = neardup.SKETCH_BITS, neardup.MINHASHES
    most = max(k for k in range(bits // 2) if 1 + np.log(1 - 2 * k / bits) * bits / (4 * n) >= floor)
    odd, lost, weight = np.eye(1, bits + 1)[0], 0.0, share**n
    for differ in range(n + 1):  # samples that differ; each toggles two bits
        lost += weight * odd[most + 1 :].sum()
        weight *= (n - differ) / (differ + 1) * (1 - share) / share
        for _ in range(2):
            odd = np.append(0, odd[:-1] * (bits - np.arange(bits)) / bits) + np.append(odd[1:] * np.arange(1, bits + 1) / bits, 0)
    return lost


def test_sketches_lose_less_than_the_bands():
    assert sketch_loss(0.75, 0.57) > 1e-5
    assert sketch_loss(0.75) < (1 - 0.75**neardup.BAND_ROWS) ** neardup.BANDS / 100


def odd_rows(texts):
    """Rows of a null id (two texts, one of them twice), a repeated id with its text, and one id with two texts."""
    long = max((t for t in texts.values() if t), key=len)
    return [(None, texts[6]), (None, long[:300]), (None, long[:300]), (7, texts[7]), (7, texts[7]), (50, texts[6] + " end"), (50, long[100:600]), (51, None), (52, ""), (1, "é" * 200)]


def in_order(rows, hashes):
    """The rows as distinct documents in the order of the operators: by id, nulls last, then by hash."""
    return sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, hashes[r[1] or ""]))


def hashes_of(spark, rows):
    from pyspark.sql import functions as F

    return {r.t: r.h for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}


def test_repeats_of_null_and_repeated_ids(spark, texts):
    rows = odd_rows(texts)
    order = in_order(rows, hashes_of(spark, rows))
    wanted = kept_bytes({k: t for k, (_, t) in enumerate(order)})
    expected = sorted(((str(i), *wanted[order.index((i, t))]) for i, t in rows), key=str)
    docs = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, _key int").repartition(3)
    found = repeats.remove_repeats(docs).collect()
    assert sorted(((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in found), key=str) == expected
    assert all(r.rest._key == 3 for r in found)


def test_near_duplicates_of_null_and_repeated_ids(spark, texts):
    rows = odd_rows(texts)
    order = in_order(rows, hashes_of(spark, rows))
    wanted = classes({k: t for k, (_, t) in enumerate(order)})
    expected = []
    for i, t in rows:
        n, first, kept = wanted[order.index((i, t))]
        expected.append((str(i), n, str(order[first][0]), kept))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = neardup.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in found) == sorted(expected)


def test_repeats_of_texts_longer_than_a_slice_equal_brute_force(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 700)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    batch = __import__("pyarrow").RecordBatch
    assert kept_locally(rows, batch) == {i: v[1] for i, v in kept_bytes(texts).items()}


def kept_locally(rows, batch):
    """Bytes removed, by the functions that tasks run, with a plain sort in the place of Spark's."""
    import pyarrow as pa
    import zstandard

    own = [(i, t or "") for i, t in rows]
    found = list(repeats._initial([batch.from_arrays([pa.array([i]), pa.array([t])], ["doc_id", "text"]) for i, t in own]))
    pack = zstandard.ZstdCompressor()
    for depth in (*repeats.REFINED, None):
        by_doc = settled(pa.Table.from_batches(found).to_pylist())
        if depth is None:
            break
        kind = pa.list_(pa.struct([("end", pa.int64()), ("place", pa.int64())]))
        batches = [batch.from_arrays([pa.array([i]), pa.array([len(t.encode())]), pa.array([pack.compress(t.encode())]), pa.array([by_doc[i]], kind)], ["doc_id", "n_bytes", "packed", "rows"]) for i, t in own if i in by_doc]
        found = list(repeats._refined(depth)(iter(batches)))
    out = {}
    for i, t in own:
        cover = np.zeros(len(t.encode()), bool)
        for row in by_doc.get(i, []):
            cover[row["place"] >> 16 : row["end"]] = True
        out[i] = int(cover.sum())
    return out


def settled(rows):
    by_doc, buckets = {}, {}
    for r in rows:
        if r["place"] & repeats.REMOVED:
            by_doc.setdefault(r["doc_id"], []).append({"end": r["name"], "place": r["place"]})
        else:
            buckets.setdefault(r["route"], []).append(r)
    for own in buckets.values():
        several, seen = len({r["name"] for r in own}) > 1, {}
        for r in sorted(own, key=lambda r: (r["name"], r["doc_id"], r["place"])):
            first = seen.setdefault(r["name"], r)
            copy = (first["doc_id"], first["place"] >> 16) != (r["doc_id"], r["place"] >> 16)
            if copy or several or r["place"] & repeats.OPEN:
                end = (r["place"] >> 16) + ((r["place"] >> 8) & 127) + repeats.LENGTH if copy else 0
                by_doc.setdefault(r["doc_id"], []).append({"end": end, "place": r["place"]})
    return by_doc
