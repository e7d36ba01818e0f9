"""Each registered query over all of sf0.001, beside a plain version of its contract."""

from __future__ import annotations

import hashlib
import itertools
import math
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from quarry.llm import bpe, merkle, packing, quality, queries, toxicity, webp
from quarry.llm.queries import QUERIES, RANKS, TOKENIZER

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def by_id(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    got = {r.doc_id: r for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize(("name", "folds", "fold"), [("op1_toxicity", 4, 2), ("op7_quality", 5, 0)])
def test_classifier_columns(spark, docs, name, folds, fold):
    got = by_id(spark, name)
    assert got.keys() == docs.keys()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % folds == fold) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    texts = {}
    for i, t in docs.items():
        texts.setdefault(t, set()).add(got[i].score)
    assert all(len(s) == 1 for s in texts.values())


def test_labels_of_held_out_rows_change_nothing(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    for module, col, folds, fold in ((toxicity, "toxic", 4, 2), (quality, "quality", 5, 0)):
        held = queries.held_out_of(folds, fold)
        turned = labels.selectExpr("doc_id", f"case when {held} then 1 - {col} else {col} end as {col}")
        a, b = module.train(d, labels, keep=f"not {held}"), module.train(d, turned, keep=f"not {held}")
        assert (a.weights == b.weights).all() and a.bias == b.bias


def test_quality_scores_are_sparse_dot_products(spark, docs):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(d, spark.read.parquet(f"{SF}/labels.parquet"), keep=f"not {queries.held_out_of(5, 0)}")
    got = by_id(spark, "op7_quality")
    for i, text in docs.items():
        counts: dict[int, int] = {}
        for b in quality.ngram_buckets(text.encode(), model.ngrams, len(model.weights).bit_length() - 1).tolist():
            counts[b] = counts.get(b, 0) + 1
        norm = math.sqrt(sum(n * n for n in counts.values())) or 1.0
        z = model.bias + sum(float(model.weights[b]) * n / norm for b, n in counts.items())
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


@pytest.mark.parametrize("prior", [0.3, 0.9])
def test_nnpu_against_dense_steps(prior):
    """The same batches and AdaGrad steps on dense rows; both signs of the corrected part occur."""
    bits, epochs, batch, rate, l1 = 4, 6, 8, 2.0, 1e-3
    rng = np.random.default_rng(5)
    rows = lambda n, lo, hi: [np.unique(rng.integers(lo, hi, 4)) for _ in range(n)]
    positive, unlabelled = rows(6, 0, 8), rows(20, 4, 12) + rows(6, 0, 8)
    got = toxicity.fit_nnpu(positive, unlabelled, prior, bits, epochs, batch, rate, l1, seed=3)
    size = 1 << bits
    dense = np.zeros((len(positive) + len(unlabelled), size))
    for i, r in enumerate(positive + unlabelled):
        dense[i, r] = 1
    least = min(max(toxicity.LEAST_TEXTS, toxicity.LEAST_SHARE * len(positive)), len(positive))
    dense[:, dense[: len(positive)].sum(axis=0) < least] = 0
    w, b = np.zeros(size), math.log(prior / (1 - prior))
    sq, sq_b, mean_w, mean_b, n, signs = np.full(size, 1e-6), 1e-6, np.zeros(size), 0.0, 0, set()
    draw = np.random.default_rng(3)
    for epoch in range(epochs):
        steps = -(-len(unlabelled) // batch)
        us = np.array_split(draw.permutation(len(unlabelled)) + len(positive), steps)
        ps = [draw.integers(0, len(positive), max(1, min(len(positive), batch // 2))) for _ in us]
        for p, u in zip(ps, us, strict=True):
            score = lambda x, w=w, b=b: 1 / (1 + np.exp(-(x @ w + b)))
            gp, gu = score(dense[p]), score(dense[u])
            rest = -np.log(1 - gu).mean() + prior * np.log(1 - gp).mean()
            signs.add(rest >= 0)
            down = lambda x, d: (x * d[:, None]).mean(axis=0)
            gw, gb = down(dense[u], gu) - prior * down(dense[p], gp), gu.mean() - prior * gp.mean()
            if rest >= 0:
                gw, gb = gw + prior * down(dense[p], gp - 1), gb + prior * (gp - 1).mean()
            else:
                gw, gb = -gw, -gb
            sq += gw * gw
            eta = rate / np.sqrt(sq)
            w = w - eta * gw
            w = np.sign(w) * np.maximum(np.abs(w) - eta * l1, 0)
            sq_b += gb * gb
            b -= rate * gb / math.sqrt(sq_b)
            if epoch >= epochs // 2:
                n += 1
                mean_w, mean_b = mean_w + (w - mean_w) / n, mean_b + (b - mean_b) / n
    assert got.weights == pytest.approx(mean_w, abs=1e-5) and got.bias == pytest.approx(mean_b, abs=1e-6)
    assert True in signs and (prior < 0.9 or False in signs)


def test_toxicity_learns_from_all_unlabelled_texts(spark):
    """Every text is in one group: the groups' sizes add up to all rows, and a word that half of all texts share weighs less than one that none has."""
    texts = ["vile foul word"] * 40 + ["calm shared word"] * 200 + ["calm other text"] * 200
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(i, 0) for i in range(40, 140)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, group=50)
    score = dict(zip(sorted(set(texts)), toxicity.scores([t.encode() for t in sorted(set(texts))], model), strict=True))
    assert score["vile foul word"] > 0.5 > 0.3 > max(score["calm shared word"], score["calm other text"])
    assert not toxicity.train(docs.where("false"), labels).weights.any()


def test_webp_columns(spark, docs):
    got = by_id(spark, "op2_webp")
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        raw = text.encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        media = webp.store(payload)
        pixels = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest())
        mean = pixels.reshape(-1, 3).mean(axis=0)
        assert r.feature.startswith(f"64x{len(pixels)} mean {' '.join(f'{v:.2f}' for v in mean)} std ")
    large = [r for r in got.values() if r.payload_bytes >= 3 * webp._LEAST_PIXELS]
    assert large and all(r.media_bytes < 0.7 * r.payload_bytes for r in large)


def test_webp_stored_forms_use_codes_references_and_cache(docs):
    """What the query stores: of larger texts, one image with prefix codes of its own, some with a cache, some with references."""
    kinds = set()
    for text in docs.values():
        media = webp.store(webp.payload_of(text.encode()))
        bits = webp.Bits(media[20:])
        bits.read(40)
        if bits.read(1):
            kinds.add("transform")
            continue
        cache = bits.read(4) if bits.read(1) else 0
        bits.read(1)
        if cache:
            kinds.add("cache")
        codes = webp._read_codes(bits, (280 + (1 << cache if cache else 0), 256, 256, 256, 40))
        kinds.add("bytes" if codes[0].fixed else "codes")
        if codes[0].bits and set(codes[0].table.tolist()) & set(range(256, 280)):
            kinds.add("references")
    assert {"bytes", "codes", "cache", "references"} <= kinds


def test_webp_stored_form_has_no_switch_by_size(docs):
    """Texts of all sizes get codes of their own, back-references and a cache by the same rule; none is stored as plain eight-bit literals."""
    small = [webp.payload_of(t.encode()) for t in docs.values() if len(t.encode()) < 4600]
    assert len(small) > 100
    for payload in small:
        media = webp.store(payload)
        assert len(media) < len(payload) and media != webp._with_bytes(np.frombuffer(payload, np.uint8).reshape(-1, 64, 3))
        assert webp.read_back(media)[:, :, :3].tobytes() == payload
    line = b"The quick brown fox jumps over the lazy dog, and the dog sleeps on. "
    for n in range(192, 9216, 192):  # what was a step at 4608 bytes
        payload = webp.payload_of((line * 136)[:n])
        assert len(webp.store(payload)) < 0.5 * len(payload) + 150


def test_webp_codes_are_level_where_that_takes_fewer_bits():
    level = np.zeros(256, np.int64)
    level[97:113] = [5, 5, 5, 5, 4, 4, 4, 4, 4, 4, 4, 4, 3, 3, 3, 3]
    code, lengths = webp._made_code(level)
    assert set(lengths[97:113]) == {4} and not lengths[:97].any() and not lengths[113:].any()
    _, steep = webp._made_code(level**6)
    assert len(set(steep[97:113])) > 1
    rng = np.random.default_rng(5)
    for n in (3, 5, 11, 17, 60, 200):  # complete, whatever is in use
        counts = np.zeros(280, np.int64)
        counts[rng.choice(280, n, replace=False)] = 1
        level = webp._level(counts)
        assert (level[counts > 0] > 0).all() and (level > 0).sum() == 1 << level.max()
        writer = webp.BitWriter()
        webp._write_code(writer, level)
        bits = webp.Bits(writer.value.to_bytes(-(-writer.size // 8) + 4, "little"))
        assert webp._read_code(bits, 280).bits == level.max() and bits.at == writer.size


def webp_company(docs):
    """Payloads of all kinds: prose, one that repeats, few colours, noise, slopes, the least and a large one."""
    rng = np.random.default_rng(3)
    odd = [b"", b"x", b"a" * 192, b"ab" * 3000, bytes(range(256)) * 40, rng.integers(0, 256, 9000).astype(np.uint8).tobytes(), np.cumsum(rng.integers(-2, 3, 9600)).astype(np.uint8).tobytes()]
    texts = [t.encode() for t in list(docs.values())[:60]]
    return [webp.payload_of(t) for t in [*odd, *texts, b" ".join(texts)]]


def test_webp_images_are_worked_on_together_and_stored_as_alone(docs, monkeypatch):
    payloads, calls = webp_company(docs), Counter()
    alone = [webp.store(p) for p in payloads]
    media = webp.store_all(payloads)
    assert media == alone and webp.store_all(payloads[::-1]) == alone[::-1]
    assert [x[:, :, :3].tobytes() for x in webp.read_all(media)] == payloads
    monkeypatch.setattr(webp, "_AT_ONCE", 1000)  # each image takes several rounds
    assert [x[:, :, :3].tobytes() for x in webp.read_all(media)] == payloads
    monkeypatch.undo()
    for name in ("_write_images", "_tokens"):
        inner = getattr(webp, name)
        monkeypatch.setattr(webp, name, lambda *a, inner=inner, name=name: (calls.update([name]), inner(*a))[1])
    small = [p for p in payloads[7:] if len(p) < 4600]
    webp.read_all(webp.store_all(small))
    assert len(small) > 20 and max(calls.values()) <= len(small) / 5


def test_webp_cached_colours_that_were_never_set_beside_other_images():
    out = webp.BitWriter()
    webp.header(out, 64, 2)
    for value, n in ((0, 1), (1, 1), (1, 4), (0, 1)):  # no transform, a cache of two colours, one group
        out.write(value, n)
    out.write(*webp._sent_codes([([280, 281], [1, 1], 282)])[0])
    for s in (0, 0, 0, 0):
        webp.write_lone(out, s)
    out.write(0, 128)
    unset = webp.wrap(out.value.to_bytes(-(-out.size // 8), "little"))
    payload = webp.payload_of(b"some words and some more words " * 30)
    good = webp.store(payload)
    got = webp.decode_all([good, unset, good])
    assert (got[1] == np.array([0, 0, 0, 255])).all() and got[1].shape == (2, 64, 4)
    assert got[0][:, :, :3].tobytes() == got[2][:, :, :3].tobytes() == payload


@pytest.mark.parametrize("kind", ["palette", "green", "left", "above"])
def test_webp_encoder_takes_transforms_where_they_pay(kind):
    rng = np.random.default_rng(1)
    image = {
        "palette": np.array([[1, 2, 3], [250, 9, 7], [4, 4, 4]], np.uint8)[rng.integers(0, 3, (64, 64))],
        "green": (rng.integers(0, 256, (64, 64, 1)) + np.zeros((1, 1, 3), int)).astype(np.uint8),
        "left": (np.cumsum(rng.integers(-2, 3, (64, 64, 3)), axis=1) + rng.integers(0, 256, (64, 1, 3))).astype(np.uint8),
        "above": (np.cumsum(rng.integers(-2, 3, (64, 64, 3)), axis=0) + rng.integers(0, 256, (1, 64, 3))).astype(np.uint8),
    }[kind]
    media = webp.encode(image)
    bits = webp.Bits(media[20:])
    bits.read(40)
    assert bits.read(1) and bits.read(2) == {"palette": webp.PALETTE, "green": webp.SUBTRACT_GREEN}.get(kind, webp.PREDICTOR)
    assert (webp.decode(media)[:, :, :3] == image).all() and len(media) < image.size * 0.8


def test_simhash_groups(spark, docs):
    got = by_id(spark, "op3_simhash")
    prints = {}
    for i, text in docs.items():
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    label = {i: i for i in docs}
    for a, b in itertools.combinations(sorted(docs), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3 and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{prints[i]:016x}", label[i]) for i in docs}


def test_merkle_columns(spark, docs):
    got = by_id(spark, "op5_merkle")
    ids = sorted(docs)
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        text, after = docs[i], docs[j]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        own, new, nxt = merkle.tree(text), merkle.tree(edited), merkle.tree(after)
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (merkle.fingerprint(own), merkle.fingerprint(new))
        assert (r.near_edited, r.near_next) == (merkle.likeness(own, new), merkle.likeness(own, nxt)) and 0 <= r.near_next <= 1


def test_packed_pieces(spark, docs):
    from tokenizers import Tokenizer

    rows = QUERIES["op6_packing"](spark, SF).collect()
    library = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in docs.items()}
    at = dict.fromkeys(docs, 0)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *part))
        at[r.doc_id] += r.length
    assert at == {i: len(x) for i, x in ids.items()}
    ends: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    total = sum(ends.values())
    padded = sum(n if n & (n - 1) == 0 else 2048 for n in ends.values())
    assert max(ends.values()) <= 2048 and padded <= 1.02 * total


def test_added_tokens_are_split_off(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    added = packing.added_tokens(public_tokenizers.path(TOKENIZER))
    texts = ["hi<|endoftext|>there", "<|endoftext|>", "<|endoftext", "a <|endoftext|><|endoftext|> b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    pieces = packing.pack_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, added=added).collect()
    assert {r.doc_id: r.doc_tokens for r in pieces} == {i: len(x) for i, x in enumerate(ids)} and 50256 in ids[0]
    for r in pieces:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))


def test_bpe_columns(spark, docs):
    got = by_id(spark, "op8_bpe")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(RANKS)), special_tokens={})
    for i, text in docs.items():
        ids = library.encode_ordinary(text)
        r = got[i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_repeated_bytes(spark, docs):
    got = by_id(spark, "op10_suffix_dedup")
    seen: dict[bytes, int] = {}
    data = {i: t.encode() for i, t in docs.items()}
    for t in data.values():
        for k in range(len(t) - 399):
            w = hashlib.blake2b(t[k : k + 400], digest_size=16).digest()
            seen[w] = seen.get(w, 0) + 1
    for i, t in data.items():
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 399):
            if seen[hashlib.blake2b(t[k : k + 400], digest_size=16).digest()] > 1:
                gone[k : k + 400] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
        assert r.text == kept.decode("utf-8", "ignore")
