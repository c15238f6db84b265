"""Bootstrapped identifiers against an independent implementation, and against what was planted."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from gaugeline.llm import pii

from .test_operators import KINDS, _base

NAMES = list(KINDS)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shaped(kind, v):
    n = len(re.sub("[^0-9]", "", v))
    return [bool(re.fullmatch("[^@]+@[^@]+", v)), bool(re.fullmatch(r"[0-9A-Fa-f]+(?:[.:]+[0-9A-Fa-f]+){3,7}", v)), 12 <= n <= 19 and bool(re.fullmatch("[0-9 -]+", v)), 7 <= n <= 15 and bool(re.fullmatch(r"[0-9() .+/-]+", v))][kind]


def contexts(text, start, stop):
    """The patterns of a match that begins where a word does."""
    left, right = text[:start], text[stop:]
    if not left or not left[-1].isspace():
        return []
    before = WORD.findall(left)
    m = re.match(r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)", right)
    out = [" ".join(before[-2:])] if len(before) > 1 else []
    return [c.lower() for c in out + ([f"{before[-1]} _ {m[1]}"] if before and m else [])]


def expected(texts, rounds=3, support=5, confidence=0.9, threshold=0.8):
    """Spans of each text; for texts whose candidates are single words."""
    found, base = [], {}  # (doc, start, stop, value, contexts), spans by doc
    edges, places = defaultdict(Counter), Counter()
    seed = {}
    for i, t in texts.items():
        base[i] = [(NAMES.index(k), a, b) for k, a, b in _base(t)]
        for k, a, b in base[i]:
            for c in contexts(t, a, b):
                edges[c][t[a:b].lower()] += 1
                seed[c, t[a:b].lower()] = min(k, seed.get((c, t[a:b].lower()), 9))
        for m in WORD.finditer(t):
            if not re.search("[0-9@]", m[0]) or any(a < m.end() and m.start() < b for _, a, b in base[i]):
                continue
            cut = m[0].lstrip("\"'([<{")
            v = cut.rstrip("\"'),.;:!?]>}")
            start = m.start() + len(m[0]) - len(cut)
            if v and (found_in := contexts(t, m.start(), m.end())):
                found.append((i, start, start + len(v), v, found_in))
                for c in found_in:
                    edges[c][v.lower()] += 1
        w = [x.lower() for x in WORD.findall(t)]
        for x, y, z in zip(w, w[1:], w[2:]):
            places[f"{x} {y}"] += 1
            places[f"{x} _ {z}"] += 1
    shapes = {v.lower(): [shaped(k, v) for k in range(4)] for *_, v, _ in found}
    known = {}
    for (_, v), k in seed.items():
        known[v] = min(k, known.get(v, 9))
    taken = {}
    for _ in range(rounds):
        taken = {}
        for c, values in edges.items():
            if len(values) < support:
                continue
            total = max(places[c], sum(values.values()))
            for k in sorted(range(4), key=lambda k: sum(n for v, n in values.items() if known.get(v) == k)):
                mine = [n for v, n in values.items() if known.get(v) == k]
                if len(mine) >= support and sum(mine) >= confidence * total:
                    taken[c] = k, sum(mine) / (total + 1)
        doubt = defaultdict(lambda: 1.0)
        for c, (k, sure) in taken.items():
            for v in edges[c]:
                if v not in known and shapes.get(v, [False] * 4)[k]:
                    doubt[v, k] *= 1 - sure
        for (v, k), d in doubt.items():
            if 1 - d >= threshold:
                known[v] = k
    spans = {i: set(b) for i, b in base.items()}
    for i, a, b, v, cs in found:
        for c in cs:
            if c in taken and shaped(taken[c][0], v):
                spans[i].add((taken[c][0], a, b))
    return {i: sorted(s) for i, s in spans.items()}


def corpus(seed, n):
    """Texts of invented words with identifiers in fixed phrases, some that rules see and some that they don't; numbers and
    addresses of the same shapes in no phrase, and phrases that mostly hold something else. The planted ones by text."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefghij", k=draw.randint(2, 6)))
    digits = lambda k: "".join(draw.choices("0123456789", k=k))
    seen = {0: lambda: f"{word()}@{word()}.com", 1: lambda: ".".join(str(draw.randint(0, 255)) for _ in range(4)), 3: lambda: f"+1{digits(10)}"}
    unseen = {0: lambda: f"{word()}@{word()}", 1: lambda: f"{draw.randint(256, 999)}.{draw.randint(1, 9)}.3.4", 3: lambda: f"555-{digits(3)}-{digits(4)}"}
    phrases = {0: "please write to {} for help", 1: "our host at {} is down", 3: "or call me {} now"}
    texts, planted = {}, {}
    for i in range(n):
        parts, mine = [], []
        at = 0

        def say(x):
            nonlocal at
            parts.append(x)
            at += len(x) + 1

        for _ in range(draw.randint(1, 5)):
            say(" ".join(word() for _ in range(draw.randint(3, 20))))
            what = draw.random()
            if what < 0.5:
                k = draw.choice(list(phrases))
                known = draw.random() < 0.93
                value = (seen if known else unseen)[k]()
                lead = phrases[k].index("{")
                mine.append((k, at + lead, at + lead + len(value), known))
                say(phrases[k].format(value))
            elif what < 0.6:
                say(f"{word()} {draw.choice(list(unseen.values()))()} {word()}")
            elif what < 0.7:
                say(f"page number {draw.choice([digits(8), digits(3), word(), seen[0]()])} of")
        texts[i], planted[i] = " ".join(parts), mine
    return texts, planted


def test_spans_equal_an_independent_implementation(spark):
    for seed in (1, 2):
        texts, planted = corpus(seed, 900)
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
        got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(df).collect()}
        assert got == expected(texts)
        added = {(i, *s) for i, spans in got.items() for s in spans if (NAMES[s[0]], s[1], s[2]) not in _base(texts[i])}
        wanted = {(i, k, a, b) for i, mine in planted.items() for k, a, b, known in mine if not known}
        assert len(wanted) > 40
        assert len(added & wanted) >= 0.95 * len(wanted)  # recall
        assert len(added & wanted) >= 0.95 * len(added)  # precision


def test_common_words_are_no_patterns(spark):
    """A pattern that holds identifiers in few of its places isn't taken, however many identifiers it holds."""
    rows = [(i, f"some of the +1555000{1000 + i} here") for i in range(40)] + [(100 + i, "some of the rest here") for i in range(20)] + [(200, "some of the 555-867-5309 here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert pii.find(df).filter("doc_id = 200 and size(spans) > 0").isEmpty()
    assert not pii.find(df.filter("doc_id < 100 or doc_id > 117")).filter("doc_id = 200 and size(spans) > 0").isEmpty()


def test_redaction_is_the_same_beyond_what_is_sent(spark, monkeypatch):
    texts, _ = corpus(3, 200)
    df = spark.createDataFrame([*texts.items(), *list(texts.items())[:20], (None, "mail a@b.com"), (500, None)], "doc_id long, text string").selectExpr("*", "'o' AS owner", "1 AS hashed", "2 AS spans").repartition(3)
    one = Counter(map(tuple, pii.redact(df).collect()))
    monkeypatch.setattr(pii, "SEND", 1)
    assert Counter(map(tuple, pii.redact(df).collect())) == one
    assert pii.redact(df).schema == df.schema
    assert one[None, "mail [EMAIL]", "o", 1, 2] == 1
    assert all(n.count("[") for n in [r.text for r in pii.redact(df.filter(F.col("text").contains("@") & F.col("text").contains(".com"))).collect()])
