"""Pieces, media, mixing, URLs, fingerprints and the pipeline."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from colloquy.llm import imatch, media, mixing, pieces, urls
from colloquy.llm.queries import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


def best_score(v, raw):
    table = {v.bytes[v.starts[i] : v.starts[i + 1]].tobytes(): s for i, s in zip(v.ids, v.scores, strict=True)}
    best = [0.0] + [-1e18] * len(raw)
    for end in range(1, len(raw) + 1):
        best[end] = max([best[end - 1] + v.byte_score] + [best[s] + table[raw[s:end]] for s in range(max(0, end - 48), end) if raw[s:end] in table])
    return best[-1]


def test_viterbi_finds_the_best_segmentation(vocabulary, texts):
    scores = dict(zip(vocabulary.ids.tolist(), vocabulary.scores.tolist(), strict=True))
    for text in [t for t in texts.values() if t and len(t) < 4000]:
        raw = b" " + text.encode()
        ids = np.concatenate(vocabulary.encode(vocabulary.segment.findall(raw)))
        assert sum(scores.get(i, vocabulary.byte_score) for i in ids.tolist()) == pytest.approx(best_score(vocabulary, raw))


def test_pieces_round_trip(docs, texts, empty, vocabulary):
    found = pieces.decode(pieces.encode(docs, vocabulary), vocabulary).collect()
    assert {r.doc_id: r.text for r in found} == texts
    assert all(r.n_tokens == len(r.token_ids or []) for r in found)
    assert pieces.encode(empty, vocabulary).count() == 0


def test_media_round_trip(docs, texts, empty):
    found = {r.doc_id: r for r in media.fingerprint(media.with_wav(docs)).collect()}
    for i, text in texts.items():
        raw = (text or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = found[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and r.media_bytes == len(payload) + 44
        assert len(r.peak_times) == len(r.peak_codes) > 0 and r.peak_times == sorted(r.peak_times)
    assert found[6].peak_codes == found[7].peak_codes != found[8].peak_codes
    assert media.fingerprint(media.with_wav(empty)).count() == 0


def test_peaks_are_paired_over_the_whole_target_zone():
    times, codes = media.peak_pairs(np.frombuffer(("abc def " * 60).encode(), np.uint8))
    assert set((codes % 4).tolist()) == {1, 2, 3}  # the distances that two bits hold
    assert np.bincount(times)[0] == 3 * len(media.BANDS) and (np.diff(times) >= 0).all()


def test_bytes_that_are_no_wav(spark):
    row = media.fingerprint(spark.createDataFrame([(1, b"junk"), (2, None)], "doc_id long, media binary")).orderBy("doc_id").collect()
    assert (row[0].payload_bytes, row[0].media_bytes, row[0].peak_codes) == (None, 4, []) and row[1].media_bytes is None


def planned(sizes):
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        level = (total - sum(capped.values())) / max(1e-9, sum(w for s, w in weights.items() if s not in capped))
        over = {s: 2.0 * sizes[s] for s in sizes if s not in capped and weights[s] * level >= 2 * sizes[s]}
        if not over:
            return {s: capped.get(s, weights[s] * level) for s in sizes}
        capped |= over


def test_mixing_meets_its_targets(docs, texts, empty):
    found = mixing.mix(docs).collect()
    sizes, target = {}, {}
    for r in found:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")) and 0 <= r.taken <= 2 * r["size"]
        sizes[r.source], target[r.source] = r.source_size, r.target
    assert {s: pytest.approx(t) for s, t in target.items()} == planned(sizes)
    for s in sizes:
        assert abs(sum(r.taken for r in found if r.source == s) - target[s]) <= 1
        assert sum(r["size"] for r in found if r.source == s) == sizes[s]
    assert sorted(mixing.mix(docs.repartition(7)).collect(), key=lambda r: r.doc_id) == sorted(found, key=lambda r: r.doc_id)
    assert mixing.mix(empty).count() == 0


def judged(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_urls_against_plain_code(spark):
    odd = [None, "", "no host", "http://", "HTTP://A.Example.ORG/es/1", "http://example.org/en/12?x://y", "https://x.com", "http://org/", "http://a.org?q/", "http://é.com/de/#://a", "a://b://c.org/x\ny"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(odd)], "page_id long, url string")
    rows = rows.unionByName(spark.read.parquet(f"{SF}/pages.parquet").select((F.col("page_id") + 100).alias("page_id"), "url"))
    model = url_model(spark)
    for r in urls.filter_urls(rows).collect():
        host, path, rule, verdict = judged(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score >= model.block_at else "allow"))


def url_model(spark):
    return urls.fit(spark.createDataFrame(urls.EXAMPLES, "url string, label int"))


def plain_grams(url):
    host, path = judged(url)[:2]
    return [zlib.crc32((mark + f"{mark}{text}$"[i : i + n]).encode()) % urls.BUCKETS for text, mark in ((host, "^"), (path, "|")) for n in urls.GRAMS for i in range(max(1, len(text) + 2 - n + 1))]


def test_url_model_equals_a_plain_descent(spark, monkeypatch):
    """A few rounds over a few URLs, row by row; scores of the operator from its weights."""
    monkeypatch.setattr(urls, "ROUNDS", 5)
    some = list(urls.EXAMPLES[:6]) + list(urls.EXAMPLES[-300:-295]) + list(urls.EXAMPLES[-6:])
    model = urls.fit(spark.createDataFrame(some, "url string, label int"))
    weights, bias = [0.0] * urls.BUCKETS, 0.0
    for _ in range(5):
        step, step_bias = [urls.L2 * w for w in weights], 0.0
        for url, label in some:
            grams = plain_grams(url)
            error = (1 / (1 + math.exp(-(bias + sum(weights[g] for g in grams) / math.sqrt(len(grams))))) - label) / len(some)
            step_bias += error
            for g in grams:
                step[g] += error / math.sqrt(len(grams))
        weights, bias = [w - urls.RATE * d for w, d in zip(weights, step, strict=True)], bias - urls.RATE * step_bias
    assert model.weights == pytest.approx(weights, abs=1e-9) and model.bias == pytest.approx(bias, abs=1e-9)
    rows = spark.createDataFrame([(u,) for u, _ in some] + [("http://x.org",), ("",), (None,)], "url string")
    for r in urls.filter_urls(rows, rules=(), examples=spark.createDataFrame(some, "url string, label int")).collect():
        grams = plain_grams(r.url) if r.url else plain_grams("://")
        assert r.score == pytest.approx(1 / (1 + math.exp(-(bias + sum(weights[g] for g in grams) / math.sqrt(len(grams))))), abs=1e-9)


def test_url_model_knows_its_examples(spark):
    rows = spark.createDataFrame(urls.EXAMPLES, "url string, label int")
    model = url_model(spark)
    found = urls.filter_urls(rows, rules=()).collect()
    assert sum((r.score >= model.block_at) == bool(r.label) for r in found) >= 0.95 * len(found)


def test_url_model_lets_unseen_urls_pass(spark):
    model = url_model(spark)
    assert model.false_positives <= urls.FALSE_POSITIVES and model.recall > 0.75
    empty = urls.fit(spark.createDataFrame([], "url string, label int"))
    assert (empty.bias, empty.block_at) == (0.0, 0.5)


def test_fingerprints(docs, texts, empty):
    ids = sorted(texts)
    own = docs.select("doc_id", "text")
    found = {r.doc_id: r for r in imatch.with_next(own, imatch.lexicon(own, low=0.02, high=0.5)).collect()}
    edited = {r.key: r.edited for r in imatch.edited_texts(own).collect()}
    assert found.keys() == edited.keys() == set(ids)
    for k, i in enumerate(ids):
        text, after = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        quarter = len(text) // 4
        assert (found[i].n_chars, edited[i]) == (len(text), text[: len(text) - quarter] + after[:quarter])
        assert found[i].edited_sha256 == hashlib.sha256(edited[i].encode()).hexdigest()
        assert 0 <= found[i].near_edited <= 1 and 0 <= found[i].near_next <= 1
    assert found[6].fingerprint == found[7].fingerprint and found[6].near_next == 1
    assert found[0].fingerprint == found[1].fingerprint
    assert imatch.with_next(empty.select("doc_id", "text"), imatch.lexicon(own)).count() == 0


def test_fingerprint_hashes_are_those_of_plain_code(spark, texts):
    rows = spark.createDataFrame([(texts[6],)], "text string")
    lexicon = imatch.lexicon(rows, low=0, high=2)
    hashes = imatch.hashes_of(rows.withColumn("doc_id", F.lit(6)), lexicon, ["doc_id"]).first().hashes
    terms = {t for t in re.split(r"[\W_]+", texts[6].lower()) if t}
    chosen = spark.createDataFrame([(t,) for t in terms], "t string").select(F.xxhash64("t").alias("h"))
    for k in (0, 13, 29):
        draw, c = divmod(k, imatch.CHOICES)
        mine = [r.h for r in chosen.where(F.pmod(F.xxhash64("h", F.lit(draw)), F.lit(imatch.ONE_IN)) == c).orderBy("h").collect()]
        wanted = spark.range(1).select(F.xxhash64(F.lit(mine).cast("array<bigint>"), F.lit(draw * imatch.ONE_IN + c)).alias("x")).first().x if mine else None
        assert (hashes[k] is None) == (wanted is None)
        assert wanted is None or hashes[k] % (1 << 32) == wanted % (1 << 32)


def test_every_lexicon_term_is_in_a_subset_of_every_draw(spark):
    words = [f"term{i}" for i in range(300)]
    held = imatch.lexicon(spark.createDataFrame([(" ".join(words),)], "text string"), low=0, high=2).where(F.col("subset") != imatch.WHOLE)
    draws = held.groupBy("term").agg(F.count_distinct(F.floor(F.col("subset") / imatch.ONE_IN)).alias("n")).collect()
    assert len(draws) == len(words) and {r.n for r in draws} == {imatch.DRAWS}


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in queries()) == list(range(1, 14))


def test_pipeline_stages(spark, tmp_path):
    from .test_dedup import classes, kept_bytes

    docs, columns = spark.read.parquet(f"{SF}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        columns, docs = docs.columns, spark.read.parquet(str(tmp_path / name))
        after = docs.select("doc_id", "text").collect()
        if name != "pieces":
            assert docs.columns == columns
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in after) == sorted(i for i, c in classes(before).items() if c[2])
        if name == "repeats":
            wanted = kept_bytes(before)
            assert {r.doc_id for r in after} == set(before)
            assert all(r.text == before[r.doc_id] for r in after if not wanted[r.doc_id][1])
            assert all(len(before[r.doc_id].encode()) - len(r.text.encode()) >= wanted[r.doc_id][1] for r in after)
        if name in ("mixing", "pieces"):
            assert all(r.text == before[r.doc_id] for r in after)
    assert docs.where("size(token_ids) <> n_tokens").count() == 0


def likeness(a, b):
    if a == b:
        return 1.0
    pairs = [(x, y) for x, y in zip(a.split("."), b.split("."), strict=False) if (x, y) != ("-", "-")]
    return sum(x == y for x, y in pairs) / len(pairs) if not a.startswith("text:") and not b.startswith("text:") and pairs else 0.0


def test_likeness_and_band_of_fingerprints(spark, docs, texts):
    own, ids = docs.select("doc_id", "text"), sorted(texts)
    lexicon = imatch.lexicon(own, low=0.1, high=0.5)
    counts = {}
    for t in texts.values():
        for term in {x for x in re.split(r"[^\w]+|_", (t or "").lower()) if x}:
            counts[term] = counts.get(term, 0) + 1
    band = [t for t, n in counts.items() if 0.1 * len(texts) <= n < 0.5 * len(texts)]
    hashes = {r.h for r in spark.createDataFrame([(t,) for t in band], "t string").select(F.xxhash64("t").alias("h")).collect()}
    assert {r.term for r in lexicon.where(F.col("subset") != imatch.WHOLE).collect()} == hashes
    found = {r.doc_id: r for r in imatch.with_next(own, lexicon).collect()}
    for k, i in enumerate(ids):
        assert found[i].near_edited == pytest.approx(likeness(found[i].fingerprint, found[i].edited_fingerprint))
        assert found[i].near_next == pytest.approx(likeness(found[i].fingerprint, found[ids[(k + 1) % len(ids)]].fingerprint))


def odd(spark, texts):
    """Null and repeated ids, and columns whose names the operators use themselves."""
    rows = [(None, texts[6], None), (None, texts[17], "a"), (5, texts[5], "a"), (5, texts[5], "a"), (8, texts[8], "b"), (8, texts[9], "b"), (9, None, None), (10, "", "b")]
    made = "id key rest size host path rule score verdict _size _key _bucket _rule _source found n which term cut source_size"
    return spark.createDataFrame([(i, t, s, *[f"own {c}" for c in made.split()]) for i, t, s in rows], "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in made.split())).repartition(3)


def test_fingerprints_of_null_and_repeated_ids(spark, texts):
    docs = odd(spark, texts)
    found = imatch.with_next(docs, imatch.lexicon(docs, low=0, high=2)).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(["None", "None", "5", "5", "8", "8", "9", "10"])
    assert len({r for r in found if r.doc_id == 5}) == 1
    # The last document, of a null id, is followed by the first.
    first = next(r.fingerprint for r in found if r.doc_id == 5)
    assert any(r.doc_id is None and r.near_next == pytest.approx(likeness(r.fingerprint, first)) for r in found)


def test_mixing_of_null_and_repeated_ids_keeps_other_columns(spark, texts):
    docs = odd(spark, texts)
    found = mixing.mix(docs).collect()
    assert len(found) == 8 and all(r[c] == f"own {c}" for r in found for c in ("id", "key", "_size", "_key", "_bucket", "_source", "found", "cut"))
    assert all(0 <= r.taken <= 2 * r["size"] for r in found)
    for s in (None, "a", "b"):
        rows = [r for r in found if r.source == s]
        assert sum(r["size"] for r in rows) == rows[0].source_size and abs(sum(r.taken for r in rows) - rows[0].target) <= 1 + len(rows)
    numbers = lambda rows: sorted((str(r.doc_id), str(r.source), r["size"], r.taken) for r in rows)
    assert numbers(mixing.amounts(docs).collect()) == numbers(found)
    low = mixing.mix(docs, quality=F.lit(-1.0)).collect()
    assert all(0 <= r.taken <= 2 * r["size"] for r in low)


def test_plans_of_many_sources_are_dealt_out_with_the_same_result(spark, docs, monkeypatch):
    wanted = sorted(mixing.amounts(docs).collect(), key=str)
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    assert sorted(mixing.amounts(docs).collect(), key=str) == wanted


def test_urls_replace_their_own_columns_only(spark, texts):
    docs = odd(spark, texts).withColumn("url", F.lit("http://a.com/de/1"))
    for r in urls.filter_urls(docs).collect():
        assert (r.host, r.path, r.rule, r.verdict) == ("a.com", "/de/1", "com/de/", "block") and r._rule == "own _rule" and r.found == "own found"
    assert urls.filter_urls(docs.where("false")).count() == 0


def test_peaks_are_those_of_a_plain_transform():
    samples = np.frombuffer(("The quick brown fox. " * 30).encode(), np.uint8)
    times, codes = media.peak_pairs(samples)
    x = np.arange(media.WINDOW)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * x / (media.WINDOW - 1))
    basis = np.exp(-2j * np.pi * np.outer(np.arange(49), x) / media.WINDOW)
    frames = [basis @ ((samples[i : i + media.WINDOW] - 128.0) * window) for i in range(0, len(samples) - media.WINDOW + 1, media.HOP)]
    power = [np.abs(f) ** 2 for f in frames]
    peaks = [[low + int(np.argmax(p[low:high])) for low, high in media.BANDS] for p in power]
    wanted = set()
    for t, own in enumerate(peaks):
        strong = max(own, key=lambda k: power[t][k])
        wanted |= {(t, (strong * 64 + k) * 4 + d) for d in range(1, media.REACH + 1) if t + d < len(peaks) for k in peaks[t + d]}
    assert len(wanted - set(zip(times.tolist(), codes.tolist(), strict=True))) <= 0.01 * len(wanted)


def test_near_sounds_share_landmarks_at_one_shift(spark):
    base = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(3000))
    rows = [(1, base), (2, base[480:]), (3, "zq " * 900)]
    found = media.fingerprint(media.with_wav(spark.createDataFrame(rows, "doc_id long, text string")))
    a, b = found.where("doc_id = 1"), found.where("doc_id <> 1").select("doc_id", F.col("peak_times").alias("t"), F.col("peak_codes").alias("c"))
    like = {r.doc_id: r.m for r in a.select("peak_times", "peak_codes").crossJoin(b).select("doc_id", media.common_landmarks(F.col("peak_times"), F.col("peak_codes"), F.col("t"), F.col("c")).alias("m")).collect()}
    assert like[2].shift == -10 and like[2].pairs > 300 and (like[3] is None or like[3].pairs < like[2].pairs / 4)


def test_very_long_text_without_blanks_is_encoded_whole(spark, vocabulary):
    text = "".join(chr(97 + (i * i) % 26) for i in range(1 << 20)) + " ▁漢" * 50
    row = pieces.decode(pieces.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), vocabulary), vocabulary).first()
    assert row.text == text


def test_segments_by_blocks_equal_those_solved_at_once(vocabulary, monkeypatch):
    raw = "".join(chr((97, 98, 101, 116, 233, 0x4E00)[(i * i + i // 3) % 6]) for i in range(4000)).encode()
    whole = vocabulary.encode([raw])[0]
    monkeypatch.setattr(pieces, "BATCH", 100)
    assert np.array_equal(vocabulary.encode([raw])[0], whole)
    solved = pieces.Solved(vocabulary)
    monkeypatch.setattr(pieces, "CACHE_BYTES", 1)
    assert all(np.array_equal(solved.ids([b" the", b" then", b" the"])[0], np.concatenate(vocabulary.encode([b" the", b" then", b" the"]))) for _ in range(3))


def test_pieces_and_media_hand_on_odd_rows(spark, texts, vocabulary):
    docs = odd(spark, texts)
    assert pieces.decode(pieces.encode(docs, vocabulary), vocabulary).where("doc_id is null").count() == 2
    back = pieces.decode(pieces.encode(docs, vocabulary).join(docs.select("doc_id", "_key", "id"), "doc_id"), vocabulary)
    assert {r._key for r in back.collect()} == {"own _key"}
    assert media.fingerprint(media.with_wav(docs)).where("doc_id is null and n_bytes > 0").count() == 2


def test_decoding_hands_on_columns_of_any_name(spark, vocabulary):
    rows = spark.createDataFrame([(1, "a b", 7, 8), (2, None, 9, 10)], "doc_id long, text string, _n long, _n0 long")
    ids = pieces.encode(rows, vocabulary).join(rows.select("doc_id", "_n", "_n0"), "doc_id")
    assert sorted((r.doc_id, r.text, r._n, r._n0) for r in pieces.decode(ids, vocabulary).collect()) == [(1, "a b", 7, 8), (2, None, 9, 10)]
