"""Each operator against a brute-force version on small rows, with nulls, empties, repeats, ties and clashing columns."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidepanel.llm import bpe, fingerprints, html_text, jaccard_join, neighbours, packing, quality, sharding, toxicity, warc
from tidepanel.llm.common import components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, row_no bigint, node bigint, perplexity string"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def documents(spark, texts, ids=None):
    rows = [(i, t, None if k % 5 == 0 else "en", None, None, 0.5, 7, 7, "x") for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts))]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def odd_texts():
    base = " ".join(f"word{k} other{k % 7}" for k in range(60))
    return [None, "", " ", "a", base, base, base.replace("word3 ", "changed "), "x" * 30_000, "é 漢字 🙂\n\n  it's 'll 123 <|endoftext|> end", "aaaa aaaa", base[::-1]]


@pytest.fixture(scope="module")
def odd(spark):
    texts = odd_texts()
    return documents(spark, [*texts, texts[4]], [*range(10), None, 4]).cache()


def rows_of(odd):
    return [(r["doc_id"], r["text"] or "") for r in odd.select("doc_id", "text").collect()]


def test_sharding_is_a_permutation():
    assert all(a * b >= n and a * b - n < max(a, 2) for n in range(1, 500) for a, b in [sharding.sides(n)])


def test_shards(spark, odd):
    got = sharding.document_shards(odd, shards=5).collect()
    want = sorted(((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in rows_of(odd)), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.document_shards(odd.repartition(7), shards=5).collect()
    assert Counter(got) == Counter(again)
    assert sharding.document_shards(odd.limit(0)).count() == 0


def feistel(x, n):
    """The same permutation in plain integers."""
    a, b = sharding.sides(n)

    def value(h, k):
        m, c = sharding.ROUNDS[k]
        once = (h * m + c) % sharding.PRIME
        return (once * once + h) % sharding.PRIME

    while True:
        left, right = x % a, x // a
        for k in range(len(sharding.ROUNDS)):
            if k % 2:
                right = (right + value(left, k)) % b
            else:
                left = (left + value(right, k)) % a
        x = right * a + left
        if x < n:
            return x


def test_permutation_follows_the_plain_one(spark):
    for n in (2, 3, 7, 50, 101):
        got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n)).collect()]
        assert got == [feistel(x, n) for x in range(n)] and sorted(got) == list(range(n))


def test_bpe_against_the_library(spark, odd):
    library = Tokenizer.from_file(BYTES)
    want = []
    for i, t in rows_of(odd):
        ids = library.encode(t, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = [tuple(r) for r in bpe.round_trips(odd, BYTES).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe.round_trips(odd.limit(0), BYTES).count() == 0


def test_packing_pieces_and_offsets(spark, odd):
    library = Tokenizer.from_file(WORDS)
    want = Counter()
    for i, t in rows_of(odd):
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[(i, k, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()))] += 1
    got = packing.packed_documents(odd, WORDS).collect()
    assert Counter(tuple(r[:5]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.packed_documents(odd.limit(0), WORDS).count() == 0


def test_sum_of_squares_follows_its_rule():
    rng = np.random.default_rng(5)
    lengths, size = rng.integers(1, 21, 300), 20
    bins, offsets = packing.sum_of_squares(lengths, size)
    counts, gap_of = Counter(), {}
    for s, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist()):
        gap = gap_of.get(b, size)
        assert o == size - gap and gap >= s

        def cost(g, s=s):
            c = counts.copy()
            if g < size:
                c[g] -= 1
            if g > s:
                c[g - s] += 1
            return sum(v * v for v in c.values())

        open_gaps = [g for g in counts if counts[g] > 0 and s <= g < size]
        assert cost(gap) == min(map(cost, open_gaps or [size]))
        if gap < size:
            counts[gap] -= 1
        if gap > s:
            counts[gap - s] += 1
        gap_of[b] = gap - s


def test_packing_wastes_little():
    lengths = -np.sort(-np.random.default_rng(1).integers(1, 2049, 5000))
    bins, _ = packing.sum_of_squares(lengths, 2048)
    assert bins.max() + 1 <= 1.01 * -(-lengths.sum() // 2048)


def test_fingerprints(spark, odd):
    ordered = sorted(rows_of(odd), key=lambda r: (r[0] is not None, r[0] or 0))
    got = {(r["doc_id"], r["n_chars"], r["edited_sha256"]): r for r in fingerprints.document_fingerprints(odd).collect()}
    want = set()
    for k, (i, t) in enumerate(ordered):
        after, half = ordered[(k + 1) % len(ordered)][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        key = (i, len(t), hashlib.sha256(edited.encode()).hexdigest())
        want.add(key)
        a, b = fingerprints.Prefixes(t), fingerprints.Prefixes(edited)
        assert got[key]["fingerprint"] == fingerprints.written(a.n, a.hash(0, a.n), fingerprints.smallest(a.spans))
        assert got[key]["edited_fingerprint"] == fingerprints.written(b.n, b.hash(0, b.n), fingerprints.smallest(b.spans))
        assert got[key]["shared_prefix"] == next((j for j, (x, y) in enumerate(zip(t, after)) if x != y), min(len(t), len(after)))
    assert want == set(got)
    assert fingerprints.document_fingerprints(odd.limit(0)).count() == 0


def test_extension_at_any_place():
    a, b = fingerprints.Prefixes("xxabcabcd tail"), fingerprints.Prefixes("abcabce")
    assert a.extension(2, b, 0) == 6 and b.extension(3, a, 2) == 3 and a.hash(2, 5) == b.hash(3, 6)


def jaccard_classes(rows):
    sets, hashes = [], jaccard_join.WordHashes()
    for _, t in rows:
        sets.append(frozenset(jaccard_join.shingles(t, hashes).tolist()))
    links = [[a != b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])) for b in range(len(rows))] for a in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[a], *(root[b] for b in range(len(rows)) if links[a][b])]) for a in range(len(rows))]
    return links, root


def near_copies(n):
    rng = np.random.default_rng(2)
    base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    out = []
    for k in range(n):
        words = list(base)
        words[int(rng.integers(0, 200))] = f"new{k}"
        out.append(" ".join(words))
    return out


def test_join_against_brute_force(spark, odd, monkeypatch):
    texts = [*odd_texts(), *near_copies(40), *(" ".join(f"u{k}_{j}" for j in range(50)) for k in range(20))]
    ids = [*range(len(texts) - 1), None]
    docs = documents(spark, [*texts, texts[4]], [*ids, 4])
    rows = sorted(rows_of(docs), key=lambda r: (r[0] is not None, r[0] or 0))
    links, root = jaccard_classes(rows)
    want = Counter((rows[a][0], rows[root[a]][0], sum(links[a])) for a in range(len(rows)))
    got = jaccard_join.linked_documents(docs).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == want
    kept = jaccard_join.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({rows[k][0]: 1 for k in set(root)})
    assert jaccard_join.linked_documents(docs.limit(0)).count() == 0
    # the same with buckets and blocks so small that groups are split and compared in several cells
    monkeypatch.setattr(jaccard_join, "BUCKET", 8)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    got = jaccard_join.linked_documents(docs).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == want


def test_join_follows_long_chains(spark):
    """Revisions that are each similar to the next alone are one class, however many there are."""
    words = [f"w{k}" for k in range(9 * 300 + 100)]
    texts = [" ".join(words[9 * k : 9 * k + 94]) for k in range(300)]
    got = jaccard_join.linked_documents(documents(spark, texts)).collect()
    assert {r["class_id"] for r in got} == {0}
    assert {r["doc_id"]: r["n_links"] for r in got} == {k: 1 if k in (0, 299) else 2 for k in range(300)}


def test_components_against_brute_force(spark):
    rng = np.random.default_rng(4)
    ids = np.unique(rng.integers(-(2**62), 2**62, 900))
    rng.shuffle(ids)
    edges = [(int(ids[k]), int(ids[k + 1])) for k in range(600) if k not in (150, 200)]
    edges += [(int(ids[700]), int(ids[k])) for k in range(701, 800)] + [(int(ids[a]), int(ids[b])) for a, b in rng.integers(800, 900, (60, 2))]
    want = {x: x for e in edges if e[0] != e[1] for x in e}
    moved = True
    while moved:
        moved = False
        for a, b in [*edges, *edges[::-1]]:
            if a != b and want[a] != want[b]:
                want[a] = want[b] = min(want[a], want[b])
                moved = True
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert len(got) == len(want) and {r["node"]: r["root"] for r in got} == want


def test_exact_similarity_of_many_sets():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[: rng.integers(200, 300)], rng.integers(0, 1 << 62, 20).astype(np.uint64)))) for _ in range(12)] + [np.zeros(0, np.uint64)]
    hit = jaccard_join.similar(sets)
    for a, x in enumerate(sets):
        for b, y in enumerate(sets):
            both = len(set(x.tolist()) & set(y.tolist()))
            assert hit[a, b] == (a != b and both > 0 and both >= 0.8 * (len(x) + len(y) - both))


def test_toxicity_learns_stems(spark):
    rng = np.random.default_rng(4)
    clean = [" ".join(f"{a}{b}" for a, b in zip(rng.choice(["so", "mi", "la", "te"], 40), rng.choice(["ran", "del", "pok"], 40))) for _ in range(300)]
    texts = [t + (f" grobble{rng.choice(['s', 'ed', 'ing'])} you" if k % 3 == 0 else "") for k, t in enumerate(clean)]
    docs = documents(spark, [*texts, None, ""], list(range(302)))
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(300)] + [(None, 1, 1), (5, None, None), (999, 0, 1)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.document_toxicity(docs, labels).collect()}
    assert len(got) == 302
    for k in range(302):
        assert got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= got[k]["score"] <= 1
        assert got[k]["predicted"] == int(got[k]["score"] >= 0.5) == int(k % 3 == 0 and k < 300)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 202
    assert toxicity.document_toxicity(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in toxicity.document_toxicity(docs, labels.limit(0)).collect()} == {0.5}


def kneser_ney(texts, common):
    """Log probability of each n-gram by the textbook recursion."""
    table = quality.folds(common)
    top = Counter(g for t in texts for g in quality.ngrams(t, table).tolist())
    counts = {quality.ORDER: top}
    for k in range(quality.ORDER - 1, 0, -1):
        counts[k] = Counter(g % quality.SYMBOLS**k for g in counts[k + 1])
    cuts = {}
    for k, c in counts.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        raw = (1 - 2 * y * n[2] / n[1] if n[1] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] else 1.0, 3 - 4 * y * n[4] / n[3] if n[3] else 1.5)
        cuts[k] = [min(max(d, 0.05), m - 0.05) for m, d in zip((1, 2, 3), raw)]

    def p(gram, k):
        if not k:
            return 1 / quality.SYMBOLS
        context = gram // quality.SYMBOLS
        lower = p(gram % quality.SYMBOLS ** (k - 1), k - 1)
        seen = [(g, n) for g, n in counts[k].items() if g // quality.SYMBOLS == context]
        if not seen:
            return lower
        total = sum(n for _, n in seen)
        freed = sum(cuts[k][min(n, 3) - 1] for _, n in seen)
        n = counts[k].get(gram, 0)
        return (n - cuts[k][min(n, 3) - 1] if n else 0) / total + freed / total * lower

    return lambda gram: np.log(p(gram, quality.ORDER))


def test_perplexity_is_kneser_ney(spark):
    trusted = ["The cat sat on the mat.", "A dog ate the cake and sat.", "the end of the day 12", ""]
    docs = documents(spark, [*trusted, "THE!! CAT!!", "zq %% xx", None], list(range(7)))
    labels = spark.createDataFrame([(k, 1, 0) for k in range(4)] + [(4, 0, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    table = docs.where("doc_id < 4")
    common = quality.alphabet(table)
    assert set(common) <= set(map(ord, "abcdefghijklmnopqrstuvwxyz .")) and quality.CAPITAL not in common
    log_p = kneser_ney(trusted, common)
    got = {r["doc_id"]: r for r in quality.document_quality(docs, labels).collect()}
    for k, text in enumerate([*trusted, "THE!! CAT!!", "zq %% xx"]):
        if text:
            want = np.exp(-np.mean([log_p(g) for g in quality.ngrams(text, quality.folds(common)).tolist()]))
            assert got[k]["perplexity"] == pytest.approx(want, rel=1e-5)
    assert got[3]["perplexity"] is None and got[6]["perplexity"] is None and not got[6]["kept"]
    assert got[0]["kept"] and got[1]["kept"] and not got[4]["kept"]
    kept = quality.without_poor(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if r["kept"]}
    assert quality.document_quality(docs.limit(0), labels).count() == 0
    assert quality.document_quality(docs, labels.limit(0)).where("kept").count() == 5


def test_perplexity_tells_letters_of_any_script_apart(spark):
    """Beside a Latin majority, Cyrillic text with its letters replaced by others must stand out as much."""
    rng = np.random.default_rng(5)
    latin, cyrillic = ["the cat ", "sat on ", "a mat and ", "ate cake. ", "bdfgijklpqrvwxyz ", "àâäçéèêëîïôöùûüñßæœø ", ",;:!?-() "], ["кошка ", "сидела ", "на коврике ", "и ела торт. "]
    texts = ["".join(rng.choice(latin, 60)) for _ in range(200)] + ["".join(rng.choice(cyrillic, 60)) for _ in range(20)]
    letters = sorted(set("".join(cyrillic)) - set(" ."))
    junk = ["".join(rng.choice(letters) if c in letters else c for c in t) for t in texts[200:210]]
    rows = [(k, t, "en" if k < 200 else "ru") for k, t in enumerate([*texts, *junk])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(k, 1) for k in range(220)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r["kept"] for r in quality.document_quality(docs, labels).collect()}
    assert all(got[k] for k in range(220)) and not any(got[k] for k in range(220, 230))


def test_limits_are_exact_quantiles(spark):
    rows = [("en", float(k)) for k in range(1, 101)] + [("fr", 5.0), (None, 200.0), ("de", None)]
    got = {r["lang"]: r["limit"] for r in quality.limits(spark.createDataFrame(rows, "lang string, lower_bound double"), 0.9).collect()}
    assert got["en"] == pytest.approx(90 * quality.MARGIN) and got["fr"] == pytest.approx(5 * quality.MARGIN) and "de" not in got and None in got


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x = "</p><p>no</p>";</script></head><body class="post"><header><h1>Site</h1></header>
<nav><ul><li><a href=/a>A</a></li><li><a href=/b>B</a></li></ul></nav><div id="cookie-banner">We use cookies to make this a better place for everyone.</div>
<article><h1>Head &amp; line</h1><p>Some &eacute;text <a href="x>y">link</a> goes&nbsp;on,<br>and<b> o</b>n. <p>Short.<div class="ad">Buy this wonderful thing now, it is very cheap!</div><p>Last
one</p></article><aside><p>Side text that is long enough to be taken for an article by its words alone.</p></aside><form><p>Your mail please</p></form>
<section class="comments"><article><p>First! A very nice article, I want to say many words about it here.</p></article></section><footer>&copy; 2020 Someone</footer><!-- end"""


def test_main_text(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, None), (3, "u", "", None), (3, "u", "", None), (None, "u", "<p>" + "long text of a page without any frame " * 20, None), (5, "u", "< not a tag <b", "y")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = sorted(html_text.main_text(pages).collect(), key=str)
    by_id = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 6 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert by_id[1] == "Head & line Some étext link goes on, and on. Short. Last one"
    assert by_id[2] == by_id[3] == "" and by_id[None] == " ".join(["long text of a page without any frame"] * 20)
    assert html_text.main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("tag", "svg math object canvas audio video datalist script style textarea noscript iframe".split())
def test_unclosed_tags_keep_the_rest_of_a_page(tag):
    got = [b[0] for b in html_text.blocks(f"<article><p>One.</p><{tag} id=x><p>Two.</p></article>")]
    assert got == (["One."] if tag in ("script", "style", "textarea", "noscript", "iframe") else ["One.", "Two."])


def test_warc_round_trip(spark):
    rows = [(5, "u", "same", 0), (3, "u\r\nX: y", "same", 0), (9, None, "same", 0), (1, "u", None, 0), (2, "u", "", 0), (4, "u", "é" * 200_000, 0), (7, "u", "a\r\n\r\nb", 0), (None, "u", "lone", 0), (3, "u", "same", 0)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, revisit int").repartition(3)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archived_pages(pages).collect() if r["verified"])
    first = {"same": 3, "": 1}
    want = Counter()
    for i, _, h, _ in rows:
        data, lead = (h or "").encode(), first.get(h or "")
        revisit = lead is not None and i != lead
        want[(i, len(data), warc.digest_text(hashlib.sha1(data).digest()), "revisit" if revisit else "response", lead if revisit else None)] += 1
    assert got == want
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_warc_reader_frames_and_verifies(tmp_path):
    payloads = [b"", b"x" * 3_000_000, b"WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"]
    data = b"".join(warc.record(k, "u", p, None, False) for k, p in enumerate(payloads))
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    with path.open("rb") as f:
        got = list(warc.read_records(f, keep_payload=True))
    assert [b"".join(r.payload) for r in got] == payloads and all(r.verified for r in got)
    with path.open("rb") as f:
        f.seek(got[2].offset)
        assert [r.headers["x-page-id"] for r in warc.read_records(f)] == ["2"]
    bad = warc.record(0, "u", b"hello", None, False).replace(b"", b"")
    text = warc.zlib.decompress(bad, 31).replace(b"hello", b"jello")
    (tmp_path / "b").write_bytes(warc.zlib.compress(text, wbits=31))
    with (tmp_path / "b").open("rb") as f:
        assert [r.verified for r in warc.read_records(f)] == [False]
    (tmp_path / "c").write_bytes(data[:-5])
    with (tmp_path / "c").open("rb") as f, pytest.raises(EOFError):
        list(warc.read_records(f))


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (50, [1.0, 1.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 1.0]), (9, []), (10, [float("inf"), 1.0])]
    table = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id bigint, embedding array<float>, score double")
    got = [tuple(r) for r in neighbours.nearest(table).orderBy("query_id", "rank").collect()]
    assert [(q, k, v) for q, k, v, _ in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (0, 4, 3), (50, 1, 0), (50, 2, 1), (50, 3, 2), (50, 4, 3)]
    assert got[0][3] == pytest.approx(1) and got[2][3] == pytest.approx(2**-0.5)
    assert neighbours.nearest(table.limit(0)).count() == 0


def test_neighbours_recall(spark, sf):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    vectors = (centres[rng.integers(0, 12, 3000)] + 0.5 * rng.normal(size=(3000, 16))).astype(np.float32)
    vectors[1000:1400] = vectors[0]  # one very common vector
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id bigint, embedding array<float>").repartition(6)
    got = defaultdict(dict)
    for r in neighbours.nearest(table).collect():
        got[r["query_id"]][r["rank"]] = r["vec_id"]
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 3000, 50):
        likeness = np.round(unit @ unit[q], 12)
        likeness[q] = -2
        want = np.lexsort((np.arange(3000), -likeness))[:5].tolist()
        hits += len(set(want) & set(got[q].values()))
        total += 5
        if q == 1000:
            assert [got[q][k] for k in range(1, 6)] == want == [0, 1001, 1002, 1003, 1004]
    assert hits / total >= 0.9


def test_balanced_parts():
    near = neighbours.neighbour_graph(neighbours.unit(np.random.default_rng(1).normal(size=(600, 8))), 8)
    part = neighbours.balanced_parts(near, 6)
    sizes = np.bincount(part, minlength=6)
    assert sizes.max() <= 111 and sizes.min() >= 90
    assert (part[near] == part[:, None]).mean() > 0.4
