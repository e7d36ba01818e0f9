from __future__ import annotations

import base64
import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from quarry.llm import bpe, likeness, merkle, packing, quality, queries, simhash, suffix_dedup, toxicity, url_filter, warc, webp
from quarry.llm.components import connected_components

PATH = public_tokenizers.path(queries.RANKS)
DOCS = "doc_id long, text string"
ODD = [(None, None), (None, "x y"), (7, None), (8, ""), (9, "a"), (9, "a"), (10, "\x00 \u00e9 \U0001f600\n\n"), (11, "word " * 4000)]


def rows(df):
    return [tuple(r) for r in df.collect()]


def with_clash(spark, data):
    """Rows with more columns, whose names are those of results."""
    df = spark.createDataFrame(data, DOCS)
    return df.select("*", *[F.lit("mine").alias(c) for c in ("score", "fp", "u", "d1", "lo", "key", "n", "fingerprint", "rule", "__text", "predicted")])


# url filter


def test_urls_against_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?y#z", "x://example.org/en/12", "x://badexample.org/en/1", "x://a.b.com/de/?q", "x://com/fr/", "x://com", "x://ORG?/es/", "a://b://org/", "x://org:80/", "x://.org/", "x://org/\n1"] * 2
    pages = spark.createDataFrame([(i if i != 3 else None, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rules = spark.createDataFrame(queries.RULES * 2, "host string, path string, verdict string")
    got = {(r.page_id, r.url): (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [r for r in queries.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        assert got[i if i != 3 else None, u] == (host, path, best and best[0] + best[1], best[2] if best else "allow"), u


def test_urls_without_rules_or_pages(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "x://org/")], "page_id long, url string")
    assert rows(url_filter.filter_urls(pages, none).select("rule", "verdict")) == [(None, "allow")]
    assert not rows(url_filter.filter_urls(pages.where("false"), none))


# simhash


def plain_simhash(text):
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", text.encode().lower() if text.isascii() else text.encode()) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_of_texts():
    for t in ["", " \n", "one", "One two", "a b c d e a b c", "x " * 50, "Zwei \u00e4pfel f\u00fcr uns"]:
        assert simhash.simhash(t.encode()) == plain_simhash(t.replace("Z", "z"))


def brute_components(values):
    values = sorted(set(values))
    label = {v: v for v in values}

    def find(v):
        while label[v] != v:
            v = label[v]
        return v

    for a, b in itertools.combinations(values, 2):
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("meeting", [1024, 2, 1])
def test_links_against_all_pairs(spark, meeting):
    rnd = random.Random(meeting)
    values = [0, -1]
    for _ in range(25):
        centre = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 2, 12])):
            values.append(simhash._signed(centre))
            for _ in range(rnd.choice([1, 2, 3, 3, 4])):
                centre ^= 1 << rnd.randrange(64)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    links = [(r.u, r.v) for r in simhash.link_fingerprints(fps, meeting=meeting).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in links)
    want = brute_components(values)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert {v: got.get(v, v) for v in want} == want


def test_near_duplicates_odd_rows(spark):
    docs = with_clash(spark, ODD + [(20, "the same words again here now"), (15, "The same  words again here now")])
    got = rows(simhash.near_duplicates(docs).orderBy("doc_id"))
    assert len(got) == len(ODD) + 2
    by_id = {i: (f, c) for i, f, c in got if i is not None}
    assert by_id[7] == by_id[8] == ("0" * 16, 7)
    assert by_id[20][1] == by_id[15][1] == 15
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {7, 9, 10, 11, 15}
    assert 20 not in {r.doc_id for r in kept.collect()}
    assert not rows(simhash.near_duplicates(docs.where("false")))


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (5, 5), (101, 100)]
    got = dict(rows(connected_components(spark.createDataFrame(edges, "u long, v long"))))
    assert all(got[i] == 0 for i in range(61)) and got[100] == got[101] == 100 and len(got) == 63
    assert not rows(connected_components(spark.createDataFrame([], "u long, v long")))


# classifiers


def corpus(n, bad, seed=0):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        words = [rnd.choice("the of and river stone light table green over under run make".split()) for _ in range(rnd.randint(5, 60))]
        label = rnd.random() < 0.3
        if label:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        out.append((i, " ".join(words), int(label)))
    return out


def judged(spark, module, classify, label_col, data):
    docs = spark.createDataFrame([d[:2] for d in data] + [(None, None), (5000, "")], DOCS)
    labels = spark.createDataFrame([(d[0], d[2]) for d in data] + [(None, 1), (77, None)], f"doc_id long, {label_col} int")
    model = module.train(docs, labels, label_col, keep="crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")
    got = rows(classify(docs, model, ["doc_id"]))
    assert len(got) == len(data) + 2 and all(0 <= s <= 1 for _, s in got)
    truth = {d[0]: d[2] for d in data if zlib.crc32(str(d[0]).encode()) % 4 == 2}
    return np.mean([(s >= module.THRESHOLD) == truth[i] for i, s in got if i in truth])


def test_quality_held_out(spark):
    data = corpus(600, ["!!", "***", "$$$"])
    assert judged(spark, quality, quality.classify_quality, "quality", data) > 0.97


def test_toxicity_held_out(spark):
    data = corpus(600, ["vile", "nasty", "scoundrel"])
    assert judged(spark, toxicity, toxicity.classify_toxicity, "toxic", data) > 0.95


def test_classifiers_without_labels_and_rows(spark):
    docs, none = with_clash(spark, ODD), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module, classify, col in ((quality, quality.classify_quality, "quality"), (toxicity, toxicity.classify_toxicity, "toxic")):
        model = module.train(docs, none, col)
        got = classify(docs, model, docs.columns)
        assert len(rows(got)) == len(ODD) and set(got.columns) >= {"doc_id", "score"}
        assert not rows(classify(docs.where("false"), model, ["doc_id"]))


def test_ftrl_takes_the_stated_steps():
    model = quality.fit_ftrl([(np.array([3]), np.array([1.0]), 1)], bits=4, epochs=1, alpha=0.5, beta=1.0, l1=0.0, l2=0.0)
    assert model.weights[3] == pytest.approx(0.5 / ((1 + 0.5) / 0.5)) and model.bias == pytest.approx(model.weights[3])
    assert not np.delete(model.weights, 3).any()


# byte-pair encoding


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_as_the_library(spark, library):
    docs = with_clash(spark, ODD + [(30, "<|endoftext|> it's we'll  \t\n 123\u0664 caf\u00e9 na\u00efve zzzzqqqq"), (31, "ab" * 3000)])
    for r in bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN, columns=["doc_id", "text"]).collect():
        want = library.encode_ordinary(r.text or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == want
        assert bytes(r.decoded) == (r.text or "").encode()


def test_perfect_hash_is_minimal():
    keys = [f"k{i}".encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert [h.find(k) for k in keys] == list(range(5000)) and sorted(h.slots.tolist()) == list(range(5000))
    assert all(h.find(f"x{i}".encode()) == -1 for i in range(2000))
    assert bpe.PerfectHash([]).find(b"a") == -1 and bpe.PerfectHash([b"a"]).find(b"a") == 0


# packing


def test_packing_keeps_every_token(spark, library):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    data = [(i, " ".join(random.Random(i).choices(["alpha", "beta", "gamma", "<|endoftext|>", "zq\u00e9x"], k=random.Random(i).randint(0, 3000)))) for i in range(60)]
    docs = spark.createDataFrame(data + [(100, None), (101, "")], DOCS).repartition(3)
    got = packing.pack_documents(docs, PATH, public_tokenizers.PATTERN, most_open=8).collect()
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in [*data, (100, None), (101, "")]}
    for i, want in ids.items():
        pieces = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got if r.doc_id == i)
        assert [p[0] for p in pieces] == [0, *itertools.accumulate(p[1] for p in pieces)][:-1]
        assert sum(p[1] for p in pieces) == len(want) == pieces[0][3]
        assert all(zlib.crc32(np.array(want[s : s + n], "<u4").tobytes()) == c for s, n, c, _ in pieces)
    for _, g in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        g = list(g)
        assert [r.offset for r in g] == [0, *itertools.accumulate(r.length for r in g)][:-1]
        total = sum(r.length for r in g)
        assert total <= 2048 and g[0].padded_length - total == 0


def test_packer_takes_the_least_sum_of_squares():
    p, rnd = packing.Packer(10), random.Random(3)
    for _ in range(300):
        size = rnd.randint(1, 9)
        level = p.choose(size)

        def squares(h, size=size):
            n = p.levels.copy()
            if h:
                n[h] -= 1
            if h + size < 10:
                n[h + size] += 1
            return int((n * n).sum())

        able = [h for h in range(11 - size) if h == 0 or p.levels[h] > 0]
        assert squares(level) == min(map(squares, able))
        list(p.add((0, 0, np.zeros(size))))


# merkle


def test_edited_fingerprints_against_brute_force(spark):
    rnd = random.Random(5)
    data = [(i * 3 % 101, "\n".join(" ".join(rnd.choices("some words are here and there then gone".split(), k=rnd.randint(1, 30))) for _ in range(rnd.randint(0, 12)))) for i in range(100)] + [(500, None), (501, "\u00e9" * 9)]
    docs = with_clash(spark, data).repartition(5)
    got = {r.doc_id: r for r in merkle.edited_fingerprints(docs).collect()}
    ordered = sorted((i, t or "") for i, t in data)
    assert len(got) == len(data)
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        assert got[i].fingerprint == merkle.fingerprint(merkle.tree(t)) and got[i].edited_fingerprint == merkle.fingerprint(merkle.tree(edited))
        assert got[i].near_next == merkle.likeness(merkle.tree(t), merkle.tree(after)) and 0 <= got[i].near_edited <= 1


def test_next_of_few_and_repeated_rows(spark):
    one = spark.createDataFrame([(1, "a b c")], DOCS)
    assert rows(merkle.edited_fingerprints(one).select("near_next")) == [(1.0,)]
    assert not rows(merkle.edited_fingerprints(one.where("false")))
    assert len(rows(merkle.edited_fingerprints(spark.createDataFrame(ODD, DOCS)))) == len(ODD)


def test_merkle_locates_edits_and_round_trips():
    lines = [f"line number {i} says {'abc' * (i % 7)} and ends." for i in range(80)]
    old = merkle.tree("\n".join(lines))
    lines[40] = "line number 40 was edited here."
    text = "\n".join(lines)
    new = merkle.tree(text)
    spans = merkle.locate_edits(old, new)
    at = text.encode().index(b"was edited")
    assert spans and all(abs(a - at) < 400 for a, b in spans) and any(a <= at < b for a, b in spans)
    assert merkle.parse(merkle.fingerprint(new)) == new and merkle.locate_edits(new, new) == []
    assert merkle.likeness(old, new) > 0.9 and merkle.likeness(old, merkle.tree("")) == 0 and merkle.parse(merkle.fingerprint(merkle.tree(""))) == merkle.tree("")
    assert sum(n for _, s in new[1] for _, p in s for _, n in p) == len(text.encode())


# webp


def test_webp_known_image():
    p = webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))
    assert p.shape == (1, 1, 4)


def literal_stream(writer, pixels):
    """Pixels (ARGB) under codes of eight bits for all four channels."""
    writer.write(0, 1)
    for alphabet in (280, 256, 256, 256):
        webp._write_bytes_code(writer, alphabet)
    webp.write_lone(writer, 0)
    for p in pixels:
        for s in (8, 16, 0, 24):
            writer.write(int(webp._REVERSED[int(p) >> s & 255]), 8)


def decoded(writer):
    return webp.decode(webp.wrap(writer.value.to_bytes(-(-writer.size // 8), "little")))


def argb(pixels):
    return [int(p[3]) << 24 | int(p[0]) << 16 | int(p[1]) << 8 | int(p[2]) for p in pixels.reshape(-1, 4)]


@pytest.mark.parametrize("mode", range(14))
def test_webp_predictor_modes(mode):
    w, h = 7, 9
    image = np.random.default_rng(mode).integers(0, 256, (h, w, 4), np.uint8)
    flat = argb(image)
    rest = []
    for y in range(h):
        for x in range(w):
            i = y * w + x
            p = (flat[i - 1] if x else 0xFF000000) if not y else flat[i - w] if not x else webp.predict(mode, flat[i - 1], flat[i - w], flat[i - w + 1], flat[i - w - 1])
            rest.append(sum(((flat[i] >> s) - (p >> s) & 255) << s for s in (0, 8, 16, 24)))
    out = webp.BitWriter()
    webp.header(out, w, h, alpha=True)
    for value, n in ((1, 1), (webp.PREDICTOR, 2), (0, 3)):
        out.write(value, n)
    literal_stream(out, [0xFF000000 | mode << 8] * 6)
    out.write(0, 1)
    out.write(0, 1)  # no cache
    # one group
    writer = out
    writer.write(0, 1)
    for alphabet in (280, 256, 256, 256):
        webp._write_bytes_code(writer, alphabet)
    webp.write_lone(writer, 0)
    for p in rest:
        for s in (8, 16, 0, 24):
            writer.write(int(webp._REVERSED[p >> s & 255]), 8)
    assert (decoded(out) == image).all()


def main_image(writer, pixels):
    writer.write(0, 1)  # no more transforms
    writer.write(0, 1)  # no cache
    writer.write(0, 1)  # one group
    for alphabet in (280, 256, 256, 256):
        webp._write_bytes_code(writer, alphabet)
    webp.write_lone(writer, 0)
    for p in pixels:
        for s in (8, 16, 0, 24):
            writer.write(int(webp._REVERSED[p >> s & 255]), 8)


def test_webp_green_and_cross_colour():
    w, h = 5, 6
    image = np.random.default_rng(1).integers(0, 256, (h, w, 4), np.uint8)
    signed = lambda v: (v & 255) - 256 if v & 128 else v & 255
    to_red, to_blue, red_to_blue = 0x1D, 0xF3, 0x81
    rest = []
    for p in argb(image):
        a, r, g, b = p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255
        blue = b - (signed(to_blue) * signed(g) >> 5) - (signed(red_to_blue) * signed(r) >> 5) & 255
        red = r - (signed(to_red) * signed(g) >> 5) & 255
        rest.append(a << 24 | (red - g & 255) << 16 | g << 8 | (blue - g & 255))
    out = webp.BitWriter()
    webp.header(out, w, h, alpha=True)
    for value, n in ((1, 1), (webp.CROSS_COLOUR, 2), (1, 3)):
        out.write(value, n)
    literal_stream(out, [0xFF000000 | red_to_blue << 16 | to_blue << 8 | to_red])
    out.write(1, 1)
    out.write(webp.SUBTRACT_GREEN, 2)
    main_image(out, rest)
    assert (decoded(out) == image).all()


@pytest.mark.parametrize("n", [2, 4, 16, 40])
def test_webp_palettes(n):
    w, h, rng = 11, 4, np.random.default_rng(n)
    colours = rng.integers(0, 256, (n, 4), np.uint8)
    index = rng.integers(0, n, (h, w))
    deltas = np.diff(colours, axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)
    out = webp.BitWriter()
    webp.header(out, w, h, alpha=True)
    for value, size in ((1, 1), (webp.PALETTE, 2), (n - 1, 8)):
        out.write(value, size)
    literal_stream(out, argb(deltas))
    bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    per, wide = 1 << bits, 8 >> bits
    packed = [sum(int(index[y, x + k]) << k * wide for k in range(per) if x + k < w) for y in range(h) for x in range(0, w, per)]
    main_image(out, [p << 8 for p in packed])
    assert (decoded(out) == colours[index]).all()


def test_webp_references_cache_and_groups():
    # green: symbols 5 (literal), 256 + 3 (a copy of four pixels), 280 + k (from the cache); two groups by an entropy image
    out = webp.BitWriter()
    webp.header(out, 8, 4)
    out.write(0, 1)
    out.write(1, 1)
    out.write(1, 4)  # a cache of two colours
    out.write(1, 1)
    out.write(0, 3)  # blocks of 4 x 4
    literal_stream(out, [0 << 8, 1 << 8])
    colour = 0xFF << 24 | 9 << 16 | 5 << 8 | 7
    slot = (colour * 0x1E35A7BD & 0xFFFFFFFF) >> 31

    def normal(lengths, alphabet):
        """A code with the given lengths, each of 1 or 2, by a code for lengths 0, 1, 2."""
        out.write(0, 1)
        order = webp._LENGTH_ORDER
        of = {0: 1, 1: 2, 2: 2}
        out.write(len(order[:9]) - 4, 4)
        for s in order[:9]:
            out.write(of.get(s, 0), 3)
        out.write(0, 1)
        for s in range(alphabet):
            n = lengths.get(s, 0)
            out.write({0: 0, 1: 0b01, 2: 0b11}[n], of[n])

    for _ in range(2):
        normal({5: 1, 259: 2, 280 + slot: 2}, 282)
        for s in (9, 7, 255):
            webp.write_lone(out, s)
        normal({0: 1, 1: 1}, 40)
    two = {5: (0, 1), 259: (0b01, 2), 280 + slot: (0b11, 2)}
    out.write(*two[5])  # literal
    out.write(*two[280 + slot])  # the same again
    n = 2
    while n < 32:
        if 32 - n >= 4:
            out.write(*two[259])
            out.write(0 if n >= 8 else 1, 1)  # one row up, or one to the left
            n += 4
        else:
            out.write(*two[5])
            n += 1
    p = decoded(out)
    assert p.shape == (4, 8, 4) and (p == np.array([9, 5, 7, 255])).all()


def test_webp_payloads_and_damage(spark):
    for text in [b"", b"x", b"a" * 192, bytes(range(256)) * 40]:
        payload = webp.payload_of(text)
        assert len(payload) % 192 == 0 and payload and webp.read_back(webp.store(payload))[:, :, :3].tobytes() == payload
    big = webp.payload_of(b"ab" * (96 * 16390))
    assert webp.read_back(webp.store(big))[:, :, :3].tobytes() == big
    good = webp.store(webp.payload_of(b"hello"))
    df = spark.createDataFrame([(1, good, "mine"), (2, good[:60], "mine"), (3, None, "mine"), (4, b"", "mine"), (5, b"RIFF" + b"\0" * 40, "mine")], "id long, image binary, width string")
    got = {r.id: r for r in webp.decode_images(df, df.columns[:1] + ["width"]).collect()}
    assert got[1].error is None and got[1].width == 64 and len(got[1].pixels) == 256
    assert all(got[i].pixels is None and got[i].error for i in (2, 3, 4, 5))
    assert len(rows(webp.media_rows(spark.createDataFrame(ODD, DOCS)))) == len(ODD)


# similar texts


def test_similar_texts_against_all_pairs(spark):
    rnd, texts = random.Random(8), ["", None, "a b", "A  b", " ".join("x" * 40)]
    line = " ".join(f"line{i}" for i in range(12))
    for _ in range(25):
        words = [f"w{rnd.randrange(9999)}" for _ in range(rnd.choice([12, 40, 150, 600]))]
        for edits in (0, 1, 1, 2, 3, 6, 10):
            copy = list(words)
            for at in rnd.sample(range(len(copy)), min(edits, len(copy) // 10)):
                copy[at] = f"v{rnd.randrange(9999)}"
            texts.append(" ".join(copy) + (f" {line}" if rnd.random() < 0.5 else ""))
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3)

    def words5(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, prints = [words5(t) for t in texts], [simhash.simhash((t or "").encode()) for t in texts]
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) if sets[a] and sets[b] else False
    label, beyond = list(range(len(texts))), 0
    for a, b in itertools.combinations(range(len(texts)), 2):
        near = (prints[a] ^ prints[b]).bit_count() <= 3
        beyond += alike(a, b) and not near
        if (near or alike(a, b)) and label[a] != label[b]:
            label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    assert beyond > 20
    assert dict(rows(simhash.similar_documents(docs).select("doc_id", "component_id"))) == dict(enumerate(label))
    prints = simhash.fingerprints(docs, similar=True).dropDuplicates(["d"])
    merged = dict(rows(likeness.merge_similar(docs, prints.select("d", "n", "h", "bands", F.col("d").alias("component")))))
    got = [merged[k] for _, k in sorted(rows(docs.select("doc_id", likeness.text_key(F.col("text")))))]
    assert all(got[a] == got[b] for a, b in itertools.combinations(range(len(texts)), 2) if alike(a, b))
    kept = simhash.keep_representatives(docs, similar=True)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))


# repeated strings


def brute_removed(texts, length, later_only=False):
    seen = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], []).append((d, i))
    out = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        for d, i in places[1:] if later_only else places if len(places) > 1 else []:
            out[d][i : i + length] = True
    return out


def texts_with_repeats(seed, length):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdef\u00e9", k=rnd.randint(1, 8)))
    fresh = lambda n: " ".join(word() for _ in range(n))
    shared = [fresh(rnd.randint(length // 6, length)) for _ in range(4)]
    out = ["", fresh(3), "ab " * length, "ab " * (length // 2), "z" * (length - 1), "z" * length]
    for _ in range(30):
        t = fresh(rnd.randint(0, 60))
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(shared)
            a = rnd.randrange(max(1, len(s) // 3))
            t += s[a : len(s) - rnd.randrange(max(1, len(s) // 3))] + fresh(rnd.randint(0, 40))
        out.append(t)
    return [*out, out[10], out[10], out[12][: len(out[12]) // 2] + " x " + out[12][len(out[12]) // 2 :]]


@pytest.mark.parametrize(("seed", "crowd", "huge"), [(1, 1000, 20000), (2, 3, 20000), (3, 3, 2), (4, 1, 1)])
def test_removed_bytes_against_brute_force(spark, seed, crowd, huge):
    length, gram = 100, 24
    texts = texts_with_repeats(seed, length)
    docs = with_clash(spark, list(enumerate(texts))).repartition(3)
    data = [t.encode() for t in texts]
    got = {r.doc_id: r for r in suffix_dedup.dedup_digests(docs, length, gram, crowd, huge).collect()}
    for i, (t, gone) in enumerate(zip(data, brute_removed(data, length), strict=True)):
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), i
    later = {r.doc_id: r.text for r in suffix_dedup.remove_later_copies(docs, length=length, gram=gram, crowd=crowd, huge=huge).collect()}
    for i, (t, gone) in enumerate(zip(data, brute_removed(data, length, True), strict=True)):
        assert later[i] == bytes(np.frombuffer(t, np.uint8)[~gone]).decode("utf-8", "ignore"), i


@pytest.mark.parametrize("huge", [20000, 1])
def test_passage_twice_in_one_text_around_a_crowded_line(spark, huge):
    length, gram, rnd = 100, 24, random.Random(5)
    fresh = lambda n: "".join(rnd.choices("abcdefgh ", k=n))
    texts = []
    for _ in range(12):
        line = fresh(60)
        passage = fresh(50) + line + fresh(50)
        texts += [fresh(150) + passage + fresh(150) + passage + fresh(150), fresh(90) + line + fresh(90), fresh(90) + line + fresh(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3)
    data = [t.encode() for t in texts]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.dedup_digests(docs, length, gram, 1, huge).collect()}
    assert got == {i: int(gone.sum()) for i, gone in enumerate(brute_removed(data, length))}
    later = {r.doc_id: r.text for r in suffix_dedup.remove_later_copies(docs, length=length, gram=gram, crowd=1, huge=huge).collect()}
    assert later == {i: bytes(np.frombuffer(t, np.uint8)[~gone]).decode() for i, (t, gone) in enumerate(zip(data, brute_removed(data, length, True), strict=True))}


def test_repeats_odd_rows(spark):
    docs = with_clash(spark, ODD)
    got = suffix_dedup.dedup_digests(docs).collect()
    assert len(got) == len(ODD)
    kept = suffix_dedup.remove_later_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(ODD)
    assert not rows(suffix_dedup.dedup_digests(docs.where("false")))


# warc


def test_warc_derivatives(spark):
    html = "<html><head><title> A &amp;  B </title></head><body><script>var t='</p>';</script><p>One <b>two</b><br>three &lt;4&gt;</p><!-- no --><a href='/x'>five</a></body></html>"
    pages = spark.createDataFrame([(1, "http://a/", html, "mine"), (2, None, None, "mine"), (2, None, None, "mine"), (None, "http://b/", "", "mine")], "page_id long, url string, html string, record_id string")
    responses = warc.responses_from_pages(pages)
    got = warc.derivatives(responses).collect()
    assert len(got) == 8
    text = next(r for r in got if r.page_id == 1 and r.warc_type == "conversion")
    meta = next(r for r in got if r.page_id == 1 and r.warc_type == "metadata")
    source = next(r for r in responses.collect() if r.page_id == 1)
    assert text.block == "One two\nthree <4>\nfive"
    assert text.refers_to == meta.refers_to == source.record_id and text.source_headers == source.headers and text.source_digest == source.payload_digest
    assert f"conversion-record-id: {text.record_id}" in meta.block and "title: A & B\r\n" in meta.block and "outlinks: 1\r\n" in meta.block and "text/html" in meta.block
    assert text.block_digest == "sha256:" + hashlib.sha256(text.block.encode()).hexdigest() and text.content_length == len(text.block.encode())
    record = next(bytes(r.record) for r in warc.warc_record(warc.derivatives(responses), "2024-01-01T00:00:00Z").collect() if b"One two" in bytes(r.record))
    assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"five\r\n\r\n") and f"WARC-Refers-To: <{source.record_id}>".encode() in record


def test_warc_text_of_odd_pages(spark):
    pages = ["a<script>x", "<p>&#72;&#x69;&#XE9;&amp;lt;&nosuch;&#0;&#xD800;&#9999999;&#160;.&copy;</p>&", "<style>p{}", None, "", "<b", "&amp;&amp;", "x<script src=y></script>z<STYLE >q</style\n>w"]
    want = ["a", "Hi\u00e9&lt;&nosuch;&#0;&#xD800;&#9999999; .\u00a9\n&", "", "", "", "<b", "&&", "x z w"]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").withColumn("url", F.lit("u"))
    got = {r.page_id: r.block for r in warc.derivatives(warc.responses_from_pages(df)).where("warc_type = 'conversion'").collect()}
    assert [got[i] for i in range(len(pages))] == want


def test_warc_text_against_the_parser(spark):
    """The words of generated pages, as the library's parser reads them."""
    from html import escape, unescape
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.hidden, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "noscript", "template", "head")
            self.out.append(" " if tag in ("p", "div", "br", "li", "td") else "")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style", "noscript", "template", "head")
            self.out.append(" " if tag in ("p", "div", "li", "td", "script", "style", "head") else "")

        def handle_comment(self, data):
            self.out.append(" ")

        def handle_data(self, data):
            self.out.append("" if self.hidden else data)

    rnd = random.Random(6)
    pages = []
    for _ in range(40):
        inner = []
        for _ in range(rnd.randint(0, 12)):
            words = escape(" ".join(rnd.choice(["one", "two & three", "<4>", "f\u00fcnf", '"six"']) for _ in range(rnd.randint(1, 4))))
            tag = rnd.choice(["p", "div", "b", "li", "script", "style", "td", "i"])
            inner.append(f"<{tag} class='c'>{words if tag not in ('script', 'style') else 'var x;'}</{tag}>" + rnd.choice(["", "<br>", " &euro;&#8212;", "<!-- no -->"]))
        pages.append("<html><head><title>t</title></head><body>" + "".join(inner) + "</body></html>")
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").withColumn("url", F.lit("u"))
    got = {r.page_id: r.block for r in warc.derivatives(warc.responses_from_pages(df)).where("warc_type = 'conversion'").collect()}
    assert unescape("&euro;") == "\u20ac"
    for i, page in enumerate(pages):
        words = Words()
        words.feed(page)
        assert got[i].split() == "".join(words.out).split(), page


def test_warc_files_round_trip(spark):
    pages = spark.createDataFrame([(1, "<p>One</p>", "http://x/1"), (2, None, None), (3, "<p>F\u00fcnf\r\n\r\n</p>", "http://x/3")], "page_id long, html string, url string")
    made = warc.derivatives(warc.responses_from_pages(pages))
    records = warc.warc_record(made, "2024-01-01T00:00:00Z")
    for kind in (records, warc.gzip_members(records)):
        data = b"".join(bytes(r.record) for r in kind.collect())
        back = warc.read_warc(spark.createDataFrame([(bytearray(data),), (None,), (bytearray(),)], "content binary")).collect()
        assert len(back) == 6 and all(r.intact for r in back)
        want = {(r.warc_type, r.record_id, r.refers_to, r.target_uri, r.source_digest, r.block) for r in made.collect()}
        assert {(r.warc_type, r.record_id, r.refers_to, r.target_uri, r.source_digest, bytes(r.block).decode()) for r in back} == want
    for bad in (b"junk", bytes(records.first().record)[:-5]):
        with pytest.raises(ValueError, match="record"):
            warc.parse_warc(bad)


def test_warc_text_ends_as_in_sql_and_hidden_parts_go_in_either_case(spark):
    pages = ["a  ", "b \u0085", "<SCRIPT>x</script>c", "<script<!-- x -->>q</script>d", "<scr<!-- -->ipt>v</script>", "<!--a<style>b-->e</style>", " \n x \n \n y \t z\r\n\n", "f&amp;lt;<STYLE>open", None]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    got = {r.i: r.t for r in df.select("i", warc.plain_text(F.col("html")).alias("t")).collect()}
    ends = [duckdb.execute(r"SELECT regexp_replace(?, '^[ \n]+|[ \n]+$', '', 'g')", [p]).fetchone()[0] for p in pages[:2]]
    assert list(got.values()) == [*ends, "c", "d", "v", "e", "x\ny z", "f&lt;", ""]
