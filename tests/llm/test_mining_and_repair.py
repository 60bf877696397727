"""Languages, hard negatives and conversations against brute force, with nulls, empties, repeats, ties and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidepanel.llm import conversations, hard_negatives, languages

CLASH = "no_conv string, part int, pos int, score double, gram string, place int, cell int, block int, label2 int"
PAD = ("x", 1, 2, 0.5, "g", 3, 4, 5, 6)


# conversations


def cheapest(rows):
    """Cost and least audit by trying every edit at every row; ``rows`` are (initial, must go, truncated)."""
    found = {}

    def walk(i, state, fresh):
        if (i, state, fresh) not in found:
            options = []
            if i == len(rows):
                options += [(0, "", ())] if state in ("", "a") else []
            else:
                initial, must, truncated = rows[i]
                later = [(2, "D", None, state)]
                if not must:
                    for letter, role, cost in (("K", initial, 0), ("R", "u", 1), ("R", "a", 1)):
                        if role and re.fullmatch(r"s?(ua)*u?", {"": "", "s": "s", "u": "u", "a": "ua"}[state] + role) and (role != "s" or state == ""):
                            later.append((cost + 5 * truncated, letter, role, role))
                for cost, letter, role, after in later:
                    c, a, roles = walk(i + 1, after, 0)
                    options.append((cost + c, letter + a, (role, *roles)))
            if fresh < 2:
                for role in "ua":
                    if role == ("a" if state == "u" else "u"):
                        c, a, roles = walk(i, role, fresh + 1)
                        options.append((5 + c, "I" + a, (role, *roles)))
            found[i, state, fresh] = min(options, default=(10**9, "", ()))
        return found[i, state, fresh]

    return walk(0, "", 0)


def repaired(rows):
    """What one conversation's row should be."""
    conv = rows[0][0]
    after = []
    for c, turn, role, text in rows:
        place = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        role, text, kind = " " if role is None else role, " " if text is None else text, zlib.crc32(place.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        after += [(turn, role, text)] * (2 if kind == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    seen, marks, counts = set(), [], Counter()
    for _, role, text in after:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        counts[fault] += 1
        marks.append((role[:1] if role[:1] in ("s", "u", "a") else "", fault in ("blank", "duplicate"), fault == "truncated"))
    cost, audit, roles = cheapest(marks)
    turns = [t for t, _, _ in after if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(after))
    lines, at = [], 0
    for letter, role in zip(audit, roles, strict=True):
        name = {"u": "user", "a": "assistant"}.get(role)
        if letter == "I":
            lines.append(f"{name}:")
            continue
        _, old, text = after[at]
        at += 1
        if letter != "D":
            lines.append(f"{old if letter == 'K' else name}:{text}")
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest)


SCHEMA = f"conv_id bigint, turn bigint, role string, text string, {CLASH}"


def conversation_rows():
    rng = random.Random(3)
    texts = ["Yes.", "Yes.", "no", "", " \t\n", "What?", "cut off", "end!  ", "漢字。", None]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "sys", "apple"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(0, 7)):
            rows.append((conv, rng.choice([turn, turn, turn, turn * 3, None, 2]), rng.choice(roles), rng.choice(texts)))
    rows += [(None, t, "user", "a.") for t in range(5)] + [(-4, None, None, None)] * 3 + [(9, 1, "user", "Yes.")] * 4
    rows += [(70, -(1 << 63), "user", "a."), (70, (1 << 63) - 1, "assistant", "b.")]
    rows += [(71, t, "user", "Same.") for t in range(40)] + [(72, t, ["user", "assistant"][t % 2], f"{t}" * 30_000 + ".") for t in range(6)]
    return rows


def test_conversations(spark):
    rows = conversation_rows()
    table = spark.createDataFrame([(*r, *PAD) for r in rows], SCHEMA).repartition(5)
    by_conv = defaultdict(list)
    for r in rows:
        by_conv[r[0]].append(r)
    want = sorted((repaired(r) for r in by_conv.values()), key=str)
    got = conversations.repaired(table)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    # turns as far apart as longs go are more than a long counts
    assert [(g[0], *(min(x, (1 << 63) - 1) if isinstance(x, int) else x for x in g[1:])) for g in want] == sorted(map(tuple, got.collect()), key=str)
    assert conversations.repaired(table.limit(0)).count() == 0


def test_a_conversation_over_many_ranges(spark):
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant", "user", "tool"]), rng.choice(["Fine.", "cut", f"{t}.", f"{t}?", " "])) for t in range(400)]
    rows += [(2, t, "user", f"{t}.") for t in range(200)] + [(0, t, "assistant", f"{t}") for t in range(90)]
    table = spark.createDataFrame([(*r, *PAD) for r in rows], SCHEMA).repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = {r["conv_id"]: tuple(r) for r in conversations.repaired(table).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for conv in (0, 1, 2):
        assert got[conv] == repaired([r for r in rows if r[0] == conv])


def test_powers_are_steps():
    for symbol in "dsuaxSUAX":
        togo = conversations.END
        for n in range(1, 40):
            togo = conversations.before(conversations.power(symbol, 0), togo)
            assert conversations.over_run(symbol, n, conversations.END) == togo
            assert conversations.before(conversations.matrix_of([(symbol, n)]), conversations.END) == togo
    runs = [("u", 9000), ("a", 5000), ("d", 3), ("u", 1)]
    audit, state = conversations.unrolled(runs, conversations.START, conversations.END)
    plain = "".join(s * n for s, n in runs)
    assert (audit, state) == conversations.unrolled([(s, 1) for s in plain], conversations.START, conversations.END)


# hard negatives


def mined(rows, every=100):
    """All pairs in plain integers."""
    kept = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        kept.setdefault(len(vector), []).append((vec_id, label, [math.floor(256 * x) for x in vector]))
    rows = max(kept.items(), key=lambda kv: (len(kv[1]), kv[0]))[1] if kept else []
    single = {}
    for vec_id, label, vector in rows:
        single[vec_id] = min(single.get(vec_id, (label, vector)), (label, vector))
    out = []
    for anchor, (label, vector) in single.items():
        if anchor % every:
            continue
        scored = sorted((-min(max(sum(a * b for a, b in zip(vector, v)), -(1 << 63)), (1 << 63) - 1), i, l == label) for i, (l, v) in single.items() if i != anchor)
        for s, positive, _ in [x for x in scored if x[2]][:5]:
            near = [(n, i) for n, i, same in scored if not same and 30 * -s <= 100 * -n <= 90 * -s][:10]
            out += [(anchor, positive, k, i, -s, -n) for k, (n, i) in enumerate(near, 1)]
    return sorted(out)


VECTORS = f"vec_id bigint, embedding array<double>, label int, {CLASH}"


def check_mined(spark, rows, every):
    table = spark.createDataFrame([(*r, *PAD) for r in rows], VECTORS).repartition(3)
    got = hard_negatives.mined(table, every=every)
    want = mined(rows, every)
    assert sorted(map(tuple, got.collect())) == want
    return want


def test_hard_negatives(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 12))
    rows = []
    for k in range(700):
        v = centres[k % 6] + rng.normal(size=12) * rng.choice([0.3, 1.0])
        rows.append((k - 100, (v / np.linalg.norm(v)).tolist(), int(rng.integers(0, 4))))
    rows += [(1000 + k, rows[0][1], rows[0][2]) for k in range(40)]  # ties
    rows += [(3, rows[103][1], 2), (3, rows[103][1], 2), (5, None, 1), (None, rows[1][1], 1), (2000, rows[1][1], None), (2100, [1.0] * 5, 1)]
    rows += [(2200, [float("nan")] + [0.0] * 11, 1), (2300, [None] + [0.0] * 11, 1), (2400, [0.0] * 12, 1), (2500, [float("inf")] + [0.0] * 11, 1)]
    assert len(check_mined(spark, rows, 20)) > 300


def test_hard_negatives_of_large_and_few_components(spark):
    rows = [(k, [float(x) for x in v], k % 3) for k, v in enumerate(itertools.product([-200000.0, 0.5, 90000.25], repeat=3))]
    assert check_mined(spark, rows, 2)
    for scale in (20, 1e6):  # beyond what doubles hold exactly, and beyond a long
        wide = [(k, [x * scale for x in v], label) for k, v, label in rows]
        assert check_mined(spark, wide, 2) or scale > 20
    assert check_mined(spark, [(k, [k / 50 - 0.2], k % 2) for k in range(40)], 10)
    assert check_mined(spark, [(0, [1.0, 0.0], 1)], 1) == []


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mined(empty).count() == 0
    assert hard_negatives.mined(spark.createDataFrame([(1, None, 1, *PAD)], VECTORS)).count() == 0


def test_cells_come_by_falling_bound_and_hold_what_they_say():
    rng = np.random.default_rng(2)
    v = np.floor(rng.normal(size=(500, 6)) * 50)
    centres = hard_negatives.codebook(v[:, :3], 5), hard_negatives.codebook(v[:, 3:], 5)
    (a, far), (b, further) = hard_negatives.assigned(v[:, :3], centres[0]), hard_negatives.assigned(v[:, 3:], centres[1])
    rows, r1, r2 = np.zeros((5, 5), dtype=int), np.zeros((5, 5)), np.zeros((5, 5))
    np.add.at(rows, (a, b), 1)
    np.maximum.at(r1, (a, b), far)
    np.maximum.at(r2, (a, b), further)
    index = hard_negatives.Index(centres, rows, (r1, r2), 6, "<f8")
    for q in v[:40]:
        visits = list(index.visits(q))
        assert [x[0] for x in visits] == sorted((x[0] for x in visits), reverse=True)
        assert sorted(x[3] for x in visits) == np.flatnonzero(rows).tolist()
        for bound, most, least, cell in visits:
            scores = v[a * 5 + b == cell] @ q
            assert least <= scores.min() and scores.max() <= min(most, bound)
        scores = v @ q
        low, high = int(np.quantile(scores, 0.9)), int(np.quantile(scores, 0.95))
        assert set((a * 5 + b)[(scores >= low) & (scores <= high)]) <= set(index.certified(q, [low], [high]))


# languages

WORDS = {"en": "the of and to in that it was for with his they", "de": "der die und das nicht ist ein mit für über schön", "ru": "и в не на что он как это все она", "zh": "的 一 是 不 了 人 我 在 有 他"}


def grams(text):
    """N-grams by their definition."""
    words = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text).split()
    padded = " " + " ".join(words) + " "
    found = Counter()
    for n in (1, 2, 3):
        for k in range(len(padded) - n + 1):
            g = padded[k : k + n]
            if g.strip() and " " not in g[1:-1] and not (n == 1 and g == " "):
                found[g] += 1
    return found


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | (1 if c == " " else ord(c))
    return out


def top(counts, k):
    return [g for g, _ in sorted(counts.items(), key=lambda kv: (-kv[1], code(kv[0])))[:k]]


def made(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "", ".", ","]) for _ in range(n))


@pytest.mark.parametrize("size", [30, 400])
def test_languages(spark, size):
    rng = random.Random(4)
    rows = [(k, made(rng, lang, rng.randint(1, 40)), lang) for k, lang in enumerate(rng.choices(list(WORDS), k=160))]
    rows += [(500, None, "en"), (501, "", "de"), (502, "123 !?", "en"), (None, "the and", "en"), (503, "the and", None), (504, "the and", None)]
    rows += [(505, "the of " * 200_000, "en"), (505, "der die", "de"), (505, "der die", "de"), (506, "x", ""), (507, "ÀÉ ıİ ǅ", "zh")]
    table = spark.createDataFrame([(*r, *PAD) for r in rows], f"doc_id bigint, text string, lang string, {CLASH}").repartition(4)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    learned = defaultdict(Counter)
    for i, text, lang in rows:
        if not held(i) and text is not None and lang is not None:
            learned[lang].update(grams(text))
    profiles = {lang: {g: k for k, g in enumerate(top(c, size))} for lang, c in learned.items() if c}
    want = []
    for i, text, _ in rows:
        if not text or not any(map(str.isalpha, text)):
            want.append((i, held(i), "und", 0.0))
            continue
        own = top(grams(text), size)
        distance, lang = min((sum(abs(k - p[g]) if g in p else size for k, g in enumerate(own)), lang) for lang, p in profiles.items())
        want.append((i, held(i), lang, 1 - distance / (size * len(own))))
    got = languages.document_languages(table, size)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = sorted(map(tuple, got.collect()), key=str)
    want = sorted(want, key=str)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-12 and 0 <= g[3] <= 1 for g, w in zip(got, want, strict=True))


def test_languages_of_nothing(spark):
    table = spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")
    assert [tuple(r)[2:] for r in languages.document_languages(table).collect()] == [("und", 0.0)]
    assert languages.document_languages(table.limit(0)).count() == 0


def test_stretches_add_up(monkeypatch):
    text = made(random.Random(1), "de", 500)
    whole = languages.text_counts(text)
    monkeypatch.setattr(languages, "STRETCH", 100)
    parts = languages.text_counts(text)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))


def test_held_out_languages_are_met(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = languages.document_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.97 * len(found)
