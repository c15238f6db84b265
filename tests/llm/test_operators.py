"""Operators against plain Python on small tables, with nulls, copies, long texts and empty tables."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gaugeline.llm import chat, mixing, near_dup, packing, sharding, token_files
from gaugeline.llm.common import shared_path
from gaugeline.llm.tokens import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TABLES = ["docs", "small", "nothing"]


@pytest.fixture(params=TABLES)
def table(request):
    return request.getfixturevalue(request.param)


def test_sharding(table):
    rows = sharding.shard(table, 24, n_slots=512).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in table.collect())
    assert Counter((r.key, r.size, r.text_crc32) for r in rows) == want
    places, load = defaultdict(list), Counter()
    for r in rows:
        places[r.shard].append(r.place)
        load[r.shard] += r.size
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert all(0 <= s < 24 for s in places)
    if rows:
        assert max(load.values()) <= sum(load.values()) / 24 + max(r.size for r in rows)


def test_equal_rows_spread_over_shards(spark, monkeypatch):
    for lot in (sharding.LOT, 300):
        monkeypatch.setattr(sharding, "LOT", lot)
        df = spark.range(2000).selectExpr("7L AS doc_id", "repeat('x', 500) AS text").union(spark.range(1000).selectExpr("CAST(NULL AS LONG)", "'y'"))
        rows = sharding.shard(df, 24).collect()
        load = Counter()
        for r in rows:
            load[r.shard] += r.size
        assert Counter((r.key, r.size) for r in rows) == {(7, 508): 2000, (None, 9): 1000}
        assert len(load) == 24
        assert max(load.values()) - min(load.values()) <= 0.05 * sum(load.values()) / 24


def test_slot_map_versions(spark, small):
    store = shared_path(spark, "test-map")
    rows = sharding.slotted(small, n_slots=256)
    totals = sharding.slot_totals(rows)
    sharding.write_map(sharding.edit_map(totals, 8), store, 1)
    first = {r.virtual_slot: r.shard for r in sharding.read_map(spark, store).collect()}
    sharding.write_map(sharding.edit_map(totals, 9, sharding.read_map(spark, store)), store, 2)
    second = {r.virtual_slot: r for r in sharding.read_map(spark, store).collect()}
    assert sharding.read_map(spark, store, 1).count() == len(first) == len(second)
    moved = [s for s in first if first[s] != second[s].shard]
    assert 0 < sum(second[s].bytes for s in moved) < sum(r.bytes for r in second.values()) / 5
    load = Counter()
    for r in second.values():
        load[r.shard] += r.bytes
    assert max(load.values()) - min(load.values()) < 2 * max(r.bytes for r in second.values())


def _water(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        t = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s: 2.0 * sizes[s] for s in free if t[s] > 2 * sizes[s]}
        if not over:
            return fixed | t
        fixed |= over


def test_mixing(table):
    rows = mixing.mix(table).collect()
    again = mixing.mix(table.repartition(5)).collect()
    assert Counter((r.key, r.size, r.taken) for r in rows) == Counter((r.key, r.size, r.taken) for r in again)
    docs = table.collect()
    assert Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in docs) == Counter((r.key, r.size) for r in rows)
    sizes, taken = Counter(), Counter()
    for r in docs:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    for r in rows:
        taken[r.pattern[0]] += r.taken
        assert r.taken in (0, r.size, 2 * r.size)
    want = _water(dict(sizes)) if docs else {}
    for r in rows:
        assert r.source_size == sizes[r.pattern[0]]
        assert r.target == pytest.approx(want[r.pattern[0]])
    for s in sizes:
        assert abs(want[s] - taken[s]) <= 1 + max(0.01 * want[s], _reachable([r.size for r in rows if r.pattern[0] == s], round(want[s])))


def test_flow_prefers_fresh_documents_and_meets_quotas():
    tokens = {("a",): 100, ("a", "b"): 100, ("b",): 10}
    routed = mixing.route(tokens, {"a": 120, "b": 100}, 2)
    got = Counter()
    for (_, s), n in routed.items():
        got[s] += n
    assert got == {"a": 120, "b": 100}
    cost = sum(max(0, sum(n for (q, _), n in routed.items() if q == p) - tokens[p]) for p in tokens)
    assert cost == 10  # 210 tokens once, 220 asked


def test_overlapping_sources(spark):
    rows = spark.createDataFrame([(i, "w " * (i % 7 + 1), ["a", "b"] if i % 3 else ["a"]) for i in range(300)] + [(300, "x y", []), (301, "z", None)], "doc_id long, text string, source array<string>")
    out = mixing.mix(rows).collect()
    assert len(out) == 302
    assert all(r.copies in (0, 1, 2) for r in out)


def _ids(name, text):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary(name))
    library.encode_special_tokens = True
    return library.encode(text or "", add_special_tokens=False).ids


def test_packing(table):
    packed = packing.pack(table, vocabulary("word_bpe_49k.json"), "dropped", 2, digest=lambda ids: __import__("pyspark.sql.functions", fromlist=["crc32"]).crc32(ids))
    rows = packed.places.collect()
    docs = defaultdict(list)
    for r in table.collect():
        docs[r.doc_id].append(_ids("word_bpe_49k.json", r.text) + [2])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, r.length, r.digest, r.doc_tokens))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for key, found in docs.items():
        want = Counter()
        for ids in found:
            for start, length in {(s, n) for s, n, _, total in by_doc[key] if total == len(ids)}:
                want[start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()), len(ids)] += 1
        assert want == Counter(by_doc[key])
        assert sum(n for _, n, _, _ in by_doc[key]) == sum(map(len, found))
    used = 0
    for p in by_sequence.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= 4096
        used += at
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    if rows:
        assert 1 - used / (4096 * len(by_sequence)) < 0.06
        one = packed.sequences().collect()
        assert len(one) == len(by_sequence)
        assert sum(len(r.ids) for r in one) >= 4 * used


def test_cut_and_best_fit():
    known = packing.classes()
    for n in [*range(1, 9000, 7), 4096, 8192]:
        parts = packing.cut(n, 4096, known, 0.04, 64)
        assert [s for s, _, _ in parts] == list(np.cumsum([0, *[x for _, x, _ in parts]])[:-1])
        assert sum(x for _, x, _ in parts) == n
        assert all(x * k <= 4096 for _, x, k in parts)
    fit = packing.best_fit([(x, (i,)) for i, x in enumerate([3000, 1000, 96, 4096, 1, 1])], 4096)
    assert len({b for b, _ in fit.values()}) == 3


def test_token_files(spark, table):
    out = shared_path(spark, "test-ids")
    token_files.write_token_ids(table, out, vocabulary("byte_bpe_50k.json"), "leading", 0)
    rows = token_files.with_checksum(token_files.read_token_ids(spark, out)).collect()
    want, start = [], 0
    got = sorted(rows, key=lambda r: r.start)
    docs = defaultdict(list)
    for r in table.collect():
        docs[r.doc_id].append(_ids("byte_bpe_50k.json", r.text) + [0])
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in table.collect()), key=lambda k: (k is not None, k))
    for r in got:
        assert r.start == start
        start += r.n_tokens
        ids = next(x for x in docs[r.doc_id] if len(x) == r.n_tokens and zlib.crc32(np.array(x, "<u4").tobytes()) == r.ids_crc32)
        docs[r.doc_id].remove(ids)
    assert not any(docs.values())


def _components(docs, percent=75):
    sets = []
    for r in docs:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")
        w = WORD.findall(w)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(docs):
        if r.doc_id is not None:
            least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    return [(r.doc_id, len(sets[i]), least.get(find(i), r.doc_id) if sets[i] else r.doc_id) for i, r in enumerate(docs)]


def test_near_duplicates(table):
    want = Counter((d, n, c, d == c) for d, n, c in _components(table.collect()))
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(table).collect())
    assert got == want
    kept = near_dup.drop_near_duplicates(table)
    assert kept.columns == table.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({d for d, _, _, k in want if k})


def test_near_duplicates_chains_and_thresholds(spark):
    """Edits that bring similarities around the threshold, in chains, and a crowd of near copies."""
    import random

    draw = random.Random(5)
    rows, k = [], 0
    for base in range(12):
        words = [f"v{draw.randint(0, 10**6)}" for _ in range(draw.choice([8, 20, 60, 200, 500]))]
        for _ in range(12):
            rows.append((k, " ".join(words)))
            k += 1
            words = list(words)
            for _ in range(draw.randint(1, max(1, len(words) // 40))):
                words[draw.randrange(len(words))] = f"v{draw.randint(0, 10**6)}"
    crowd = [f"c{i}" for i in range(120)]
    for _ in range(150):
        w = list(crowd)
        w[draw.randrange(120)] = f"z{draw.randint(0, 10**6)}"
        w[draw.randrange(120)] = f"z{draw.randint(0, 10**6)}"
        rows.append((k, " ".join(w)))
        k += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter((d, n, c, d == c) for d, n, c in _components(df.collect()))
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect()) == want


def _brute(df):
    return Counter((d, n, c, d == c) for d, n, c in _components(df.collect()))


def _judged(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect())


def test_near_duplicates_without_ids_and_with_ids_that_repeat(spark):
    base = " ".join(f"b{i}" for i in range(60))
    other = " ".join(f"o{i}" for i in range(60))
    lone = " ".join(f"l{i}" for i in range(60))
    rows = [(5, base), (None, base + " extra"), (9, base + " other"), (None, lone), (None, lone + " x"), (3, other), (3, lone + " y z"), (-7, other + " w"), (-7, "five words are here now"), (None, ""), (None, ""), (4, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' AS doc", "1 AS hashed", "true AS first", "2 AS many", "3 AS lots", "map(1, doc_id) AS lot").repartition(3)
    got = _judged(df)
    assert got == _brute(df)
    assert got[9, 57, 5, False] == 1
    kept = near_dup.drop_near_duplicates(df)
    assert kept.schema == df.schema
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == {(5, base): 1, (3, lone + " y z"): 1, (-7, other + " w"): 1, (-7, "five words are here now"): 1, (None, ""): 2, (4, None): 1, (4, ""): 1}


@pytest.mark.parametrize("send", [0, near_dup.SEND])
def test_near_duplicates_of_crowds_and_shared_passages(spark, monkeypatch, send):
    """Keys beyond the salting bound, copies of one row, and texts that share a passage but aren't near copies."""
    import random

    monkeypatch.setattr(near_dup, "SEND", send)
    monkeypatch.setattr(near_dup, "LOT", 4)
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 7)
    draw, rows = random.Random(12), []
    fresh = lambda n: [f"u{draw.randint(0, 10**9)}" for _ in range(n)]
    passage = fresh(70)
    for i in range(60):
        rows.append((i, " ".join(passage + fresh(draw.choice([3, 8, 12, 16, 20, 30, 60])))))
    for i in range(60, 80):
        rows.append((i, " ".join(passage + fresh(5) + passage[:20])))
    rows += [(100, "all of these rows are one and the same text")] * 40
    rows += [(101 + i, "all of these rows are one and the same text") for i in range(30)]
    chain = fresh(50)
    for i in range(30):
        rows.append((200 + i, " ".join(chain)))
        chain = [*chain[1:], *fresh(1)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert _judged(df) == _brute(df)
    kept = near_dup.drop_near_duplicates(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted({d for d, _, c in _components(df.collect()) if d == c})


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    for size in (60, 500, 600, 5000):
        for share in (0.3, 0.75, 0.95):
            n = int(size * share)
            pool = np.unique(rng.integers(0, 2**64, 2 * size, dtype=np.uint64))
            rng.shuffle(pool)
            a, b = np.sort(pool[:size]), np.sort(np.concatenate((pool[:n], pool[size : 2 * size - n])))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            j, used = near_dup.estimate(near_dup.registers(a)[None], near_dup.registers(b)[None], np.array([len(a)]), np.array([len(b)]))
            assert abs(j[0] - true) < 0.2
            assert used[0] > 100


LOG = [
    ("c", 1, 0, "message", "user", "Hi <|im_end|>"),
    ("c", 2, 1, "message", "assistant", ""),
    ("c", 3, 1, "delta", "", "Hel"),
    ("c", 5, 1, "delta", "", "o"),
    ("c", 4, 1, "delta", "", "l"),
    ("c", 6, 2, "message", "user", "bad"),
    ("c", 7, 1, "regenerate", "", ""),
    ("c", 8, 1, "delta", "", "Hey &lt;| & <|"),
    ("c", 9, 0, "edit", "", "Hi there"),
    ("d", 1, 0, "message", None, None),
    ("d", 2, 1, "message", "a\n<|b", "x"),
    ("d", 3, 0, "delete", "", ""),
    (None, 1, 0, "message", "assistant", "lone"),
]


def test_chat_reconstruction(spark):
    log = spark.createDataFrame(LOG, "conv_id string, seq long, turn long, kind string, role string, text string")
    out = chat.format_chat(log)
    read = {r.conv_id: r for r in out.select("conv_id", "formatted", chat.parse(out.formatted).alias("turns"), chat.under_loss(out.formatted, out.loss_spans).alias("loss")).collect()}
    assert [tuple(t) for t in read["c"].turns] == [("user", "Hi there"), ("assistant", "Hey &lt;| & <|")]
    assert read["c"].loss == ["Hey &lt;| & <|"]
    assert [tuple(t) for t in read["d"].turns] == [("a\n<|b", "x")]
    assert read[None].loss == ["lone"]
    assert read["c"].formatted.count("<|im_start|>") == 2
    assert chat.format_chat(log.limit(0)).count() == 0


def _folded(events):
    """The messages that the events of a conversation leave, one after the other."""
    out = []
    for _, turn, kind, role, text in sorted(events, key=lambda e: tuple((x is not None, x) for x in e)):
        there = [m for m in out if turn is not None and m[0] == turn]
        if kind == "delete":
            out = [m for m in out if turn is None or m[0] != turn]
        elif kind == "regenerate":
            for m in there:
                m[2] = text
            out = [m for m in out if turn is None or m[0] is None or m[0] <= turn]
        elif not there:
            out.append([turn, role, text])
        else:
            there[0][1] = role or there[0][1]
            there[0][2] = there[0][2] + text if kind == "delta" else text
    return [(r, t) for _, r, t in out]


def test_fold_equals_one_event_after_the_other(spark):
    draw = __import__("random").Random(9)
    logs = {c: [(draw.randint(0, 30), draw.choice([None, 0, 1, 2, 3, 4]), draw.choice(["message", "delta", "delta", "edit", "regenerate", "delete"]), draw.choice(["", "user", "assistant"]), draw.choice(["", "a", "bc", "<|"])) for _ in range(draw.randint(1, 14))] for c in range(400)}
    df = spark.createDataFrame([(c, *e) for c, events in logs.items() for e in events], "conv_id long, seq long, turn long, kind string, role string, text string").repartition(5)
    got = {r.conv_id: [tuple(m) for m in r.messages] for r in chat.reconstruct(df).collect()}
    assert got == {c: _folded(events) for c, events in logs.items()}


@pytest.mark.parametrize("as_log", [chat.messages_as_events, chat.messages_as_streams])
def test_chat_round_trip_of_hostile_texts(spark, as_log):
    draw = __import__("random").Random(2)
    parts = ["<|im_end|>", "<|im_start|>", "<|", "<", "|", "&", "&amp;", "&lt;|", "&nl;", "\n", "assistant", " ", "é😀", "\\", ""]
    rows = [(c, t, "".join(draw.choices([*parts, "assistant", "assistant"], k=draw.choice([1, 3]))), "".join(draw.choices(parts, k=draw.randint(0, 9)))) for c in range(60) for t in range(4)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS seq", "2 AS at", "'x' AS kind")
    out = chat.format_chat(as_log(df))
    for r in out.select("conv_id", chat.parse(out.formatted).alias("turns")).collect():
        assert [tuple(t) for t in r.turns] == [(a, b) for _, _, a, b in sorted(x for x in rows if x[0] == r.conv_id)]


def test_streamed_logs_hold_every_kind_of_event(spark):
    df = spark.createDataFrame([(1, 0, "user", "ask"), (1, 1, "assistant", "answer"), (2, 0, None, None)], "conv_id long, turn long, role string, text string")
    log = chat.messages_as_streams(df)
    assert {r.kind for r in log.collect()} == {"message", "delta", "edit", "regenerate"}
    assert log.count() == 15
    got = {r.conv_id: [tuple(m) for m in r.messages] for r in chat.reconstruct(log).collect()}
    assert got == {1: [("user", "ask"), ("assistant", "answer")], 2: [("", "")]}


@pytest.mark.parametrize("rule", ["start", "end", "most"])
def test_section_tokens(spark, docs, small, rule):
    from tokenizers import Tokenizer

    from gaugeline.llm import token_counts

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    table = docs.filter("doc_id <> 10").select("doc_id", "text").union(small.filter("doc_id < 40").selectExpr("doc_id + 1000", "text"))
    want = Counter()
    for r in table.collect():
        text = r.text or ""
        lines, at = [], 0
        for part in text.split("\n"):
            lines.append((at, min(len(text), at + len(part) + 1)))
            at += len(part) + 1
        counts = [0] * len(lines)
        raw, points = text.encode(), []
        for i, c in enumerate(text):
            points += [i] * len(c.encode())
        at = 0
        for i in library.encode(text, add_special_tokens=False).ids:
            n = len(library.id_to_token(i))
            first, last = points[at], points[at + n - 1]
            at += n
            held = [min(b, last + 1) - max(a, first) if min(b, last + 1) > max(a, first) else 0 for a, b in lines]
            k = next(j for j, (a, b) in enumerate(lines) if a <= first < b) if rule == "start" else next(j for j, (a, b) in enumerate(lines) if a <= last < b) if rule == "end" else held.index(max(held))
            counts[k] += 1
        assert at == len(raw)
        for j, (a, b) in enumerate(lines):
            want[r.doc_id, j, a, b, counts[j]] += 1
    got = token_counts.section_tokens(table, vocabulary("byte_bpe_50k.json"), rule).collect()
    assert Counter((r.doc_id, r.section, r.start, r.stop, r.n_tokens) for r in got) == want


def test_crossing_tokens_follow_the_rule():
    from gaugeline.llm import token_counts

    first, past = np.array([0, 2, 6]), np.array([2, 6, 8])  # the second token crosses 3
    for rule, want in (("start", [2, 1, 0]), ("end", [1, 2, 0]), ("most", [1, 2, 0])):
        n, crossing = token_counts.attribute([(0, 3), (3, 9)], first, past, rule)
        assert n.tolist() == want
        assert crossing.sum() == 1
    n, _ = token_counts.attribute([(2, 3)], first, past, "most")
    assert n.tolist() == [0, 3]


def _stats(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    covered = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_quality(spark, table):
    from gaugeline.llm import quality

    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = quality.score_documents(table, labels).collect()
    want = Counter((r.doc_id, *_stats(r.text)) for r in table.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = quality.keep(table, labels)
    assert kept.schema == table.schema
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if r.kept)
    alone = quality.score_documents(table, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in alone)


def test_quality_on_held_out_labels(spark):
    from gaugeline.llm import quality

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.score_documents(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id").select("quality", "kept").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.97 * len(good)
    assert sum(bad) <= 0.03 * len(bad)


def test_forest_uses_every_statistic_and_no_fixed_threshold(spark):
    """Texts that leave the good ones' range in one rate each are rejected; which range that is follows from the labels."""
    draw = __import__("random").Random(2)
    made = lambda n: [draw.choice(["alpha", "beta", "gamma", "delta", "word", "other", "thing", "place", "time"]) + str(draw.randint(0, 999)) for _ in range(n)]
    good = lambda: "\n".join(" ".join(made(draw.randint(6, 9))) for _ in range(draw.randint(5, 30)))
    odd = {
        "symbols": lambda: " ".join(w + "##" for w in made(80)),
        "upper": lambda: " ".join(w.upper() for w in made(80)),
        "marks": lambda: " ".join(w + "!!" for w in made(80)),
        "echo": lambda: " ".join(w + " " + w for w in made(80)),
        "long": lambda: " ".join(a + b + c for a, b, c in zip(made(80), made(80), made(80), strict=True)),
        "lines": lambda: "\n".join(made(80)),
        "few": lambda: " ".join(draw.choices(made(12), k=90)),
    }
    rows = [(i, good(), 1) for i in range(400)]
    rows += [(1000 + 100 * k + i, make(), 0) for k, make in enumerate(odd.values()) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    from gaugeline.llm import quality

    labels = docs.filter("doc_id % 3 > 0").select("doc_id", "quality")
    scored = quality.score_documents(docs.select("doc_id", "text"), labels).filter("doc_id % 3 = 0").collect()
    kept = defaultdict(list)
    for r in scored:
        if not r.base_failed:
            kept["good" if r.doc_id < 1000 else list(odd)[(r.doc_id - 1000) // 100]].append(r.kept)
    assert sum(kept.pop("good")) >= 120
    assert len(kept) == len(odd)
    assert {k: sum(v) for k, v in kept.items()} == dict.fromkeys(odd, 0)
    usual_marks = spark.createDataFrame([(i, odd["marks"](), 1) for i in range(100)], "doc_id long, text string, quality int")
    again = quality.score_documents(usual_marks.select("doc_id", "text"), usual_marks.select("doc_id", "quality").filter("doc_id < 60"))
    assert again.filter("kept").count() == 100


def test_verdicts_follow_the_published_algorithm(spark, small):
    """Scores against an independent forest walk, row by row and tree by tree."""
    from gaugeline.llm import quality

    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    forest = quality.fit(small, labels)
    texts = [r.text for r in small.collect()]
    stats = np.array([quality.text_stats(t) for t in texts])
    x = quality.features(stats, forest.span)
    norm = lambda n: 0 if n < 2 else 1 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
    for row, got in zip(x, forest.score(x), strict=True):
        paths = []
        for t in range(forest.trees):
            node = 0
            while np.isfinite(forest.cut[t, node]):
                node = 2 * node + (2 if row[forest.feature[t, node]] > forest.cut[t, node] else 1)
            paths.append(forest.path[t, node])
        assert got == pytest.approx(2 ** (-np.mean(paths) / norm(min(256, forest.rows))))
    rows = {r.doc_id: r for r in quality.score_documents(small, labels).collect()}
    for r, s, f in zip(small.collect(), forest.score(x), quality.base_failed(stats), strict=True):
        assert rows[r.doc_id].kept == (not f and s <= forest.threshold)


def test_repeated_words_of_long_windows():
    from gaugeline.llm import quality

    draw = __import__("random").Random(4)
    for _ in range(300):
        text = " ".join(draw.choice("ab") if draw.random() < 0.5 else str(draw.randint(0, 30)) for _ in range(draw.randint(0, 60)))
        assert quality.text_stats(text)[:5] == _stats(text)


KINDS = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and _luhn(re.sub("[^0-9]", "", m))),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def _luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _base(text):
    return [(k, m.start(), m.end()) for k, (p, ok) in KINDS.items() for m in p.finditer(text or "") if ok(m[0])]


def _said(r):
    from gaugeline.llm import pii

    return [(pii.KINDS[s.kind], s.start, s.stop) for s in r.base]


def test_pii_rules(spark, table):
    from gaugeline.llm import pii

    want = Counter((r.doc_id, tuple(_base(r.text))) for r in table.collect())
    rows = pii.find(table).collect()
    assert Counter((r.doc_id, tuple(_said(r))) for r in rows) == want
    assert all({tuple(s) for s in r.base} <= {tuple(s) for s in r.spans} for r in rows)
    out = pii.redact(table)
    assert out.columns == table.columns
    for r in out.collect():
        assert not _base(r.text) or r.text is None


def test_pii_rules_on_hostile_texts(spark):
    from gaugeline.llm import pii

    draw = __import__("random").Random(6)
    bits = ["a", "b.", "@", "x@y.z", ".", "1", "22", "256", "0", "255", "-", " ", "+1", "(", ")", "4111111111111111", "é", "😀", "_", "%", "1.2.3.4", "00", "\n"]
    texts = ["".join(draw.choices(bits, k=draw.randint(1, 40))) for _ in range(3000)]
    texts += ["a" * 200_000, "1" * 200_000, "1." * 20_000, "+" + "1 " * 20_000, "a@" + "b." * 50_000, "@" * 100_000, "1 " * 20_000 + "a@b.c", "+1" + "(" * 100_000, "x " * 50_000 + "1.2.3.4 é 4.3.2.1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    for r in pii.find(df).collect():
        text = texts[r.doc_id]
        if len(set(text)) == 1 and len(text) > 1000:  # Python's matcher is quadratic there; none of them holds a match
            assert _said(r) == []
        else:
            assert _said(r) == _base(text), repr(text[:200])


def test_pii_patterns_find_unseen_identifiers(spark):
    from gaugeline.llm import pii

    seeds = [(i, f"please call me at +1 (2{i:02d}) 555-10{i:02d} soon") for i in range(30)] + [(100 + i, f"server log host 10.0.0.{i} is up") for i in range(30)]
    unseen = [(200, "please call me at 555-867-5309 soon"), (201, "server log host fe80:12:0:99:1:2:3:4 is up"), (202, "chapter two of 555-867-5309 pages"), (203, "please call me at 9am soon")]
    df = spark.createDataFrame(seeds + unseen, "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find(df).collect()}
    added = {k: [(pii.KINDS[s.kind], s.start, s.stop) for s in rows[k].spans] for k in (200, 201, 202, 203)}
    assert added == {200: [("phone", 18, 30)], 201: [("ip", 16, 36)], 202: [], 203: []}
    assert pii.redact(df).filter("doc_id = 200").first().text == "please call me at [PHONE] soon"


def test_code_search(spark):
    from gaugeline.llm import code_search

    draw = np.random.default_rng(8)
    base = draw.normal(size=(300, 64))
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(base)]
    rows += [(1000 + i, [float(x) for x in base[7]], 1) for i in range(80)]  # a crowd of equal codes
    rows += [(2000 + i, [float(x) for x in base[7] + draw.normal(size=64) * 0.4], 1) for i in range(60)]
    rows += [(3000, None, 1), (3001, [None] + [1.0] * 63, 1), rows[5], rows[5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    asked = df.filter("vec_id % 7 = 0")
    codes = {i: tuple(x > 0 for x in v) for i, v, _ in rows if v is not None and None not in v}
    want = set()
    for q in {r.vec_id for r in asked.collect()} & set(codes):
        near = sorted((sum(a != b for a, b in zip(codes[q], codes[i], strict=True)), i) for i in codes if i != q)
        want |= {(q, k, i, d) for k, (d, i) in enumerate(near[:10], 1)}
    got = [tuple(r) for r in code_search.search(df, asked, 10).select("query_id", "rank", "neighbour_id", "distance").collect()]
    assert len(got) == len(set(got))
    assert set(got) == want
    assert code_search.search(df.limit(0), asked.limit(0), 10).count() == 0
    few = code_search.search(df.filter("vec_id < 4"), asked.filter("vec_id = 0"), 10).collect()
    assert len(few) == 3


def test_code_search_in_vectors_of_any_width(spark):
    from gaugeline.llm import code_search

    draw = np.random.default_rng(18)
    for width in (1, 65, 128, 200):
        base = draw.normal(size=(40, width))
        rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
        rows += [(100 + i, [float(x) for x in base[i % 3] + draw.normal(size=width) * 0.3]) for i in range(40)]
        rows += [(200, [1.0] * (width - 1)), (201, [1.0] * max(1, width // 2)), (202, []), (203, None)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS c0", "2 AS q0", "3 AS bound")
        codes = {i: [False] * (width - len(v)) + [x > 0 for x in v] for i, v in rows if v is not None}
        asked = df.filter("vec_id % 20 = 0 or vec_id > 199")
        want = set()
        for q in {r.vec_id for r in asked.collect()} & set(codes):
            near = sorted((sum(a != b for a, b in zip(codes[q], codes[i], strict=True)), i) for i in codes if i != q)
            want |= {(q, k, i, d) for k, (d, i) in enumerate(near[:5], 1)}
        got = [tuple(r) for r in code_search.search(df, asked, 5).select("query_id", "rank", "neighbour_id", "distance").collect()]
        assert len(got) == len(set(got))
        assert set(got) == want


def _reachable(sizes, target, most=2):
    """The nearest sum of sizes, each 0 to `most` times, as a set of bits."""
    sums = 1
    for n in sizes:
        for _ in range(most):
            sums |= sums << n
    return min((abs(i - target) for i in range(int(2 * target) + 2) if sums >> i & 1), default=target)


def test_mixes_come_as_near_as_documents_allow(spark, small):
    rows = mixing.mix(small).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.pattern[0]].append(r)
    for found in by.values():
        off = abs(sum(r.taken for r in found) - found[0].target)
        assert off <= max(1, 0.01 * found[0].target) or off <= _reachable([r.size for r in found], found[0].target) + 1
        if len(found) <= 20:
            assert off <= max(1 + _reachable([r.size for r in found], round(found[0].target)), 0.001 * found[0].source_size + 1)


def test_small_sources_against_all_sums(spark):
    draw = __import__("random").Random(3)
    rows, k = [], 0
    for s in range(30):
        for _ in range(draw.randint(1, 9)):
            rows.append((k, "w " * draw.choice([0, 1, 7, 30, 90, 400, 2000]), f"s{s:02d}"))
            k += 1
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = defaultdict(list)
    for r in out:
        by[r.pattern[0]].append(r)
    for found in by.values():
        assert all(0 <= r.copies <= 2 for r in found)
        off = abs(sum(r.taken for r in found) - round(found[0].target))
        assert off <= max(_reachable([r.size for r in found], round(found[0].target)), found[0].source_size / 1000)


def test_nearest_sums():
    draw = __import__("random").Random(1)
    for _ in range(200):
        sizes = [draw.randint(0, 60) for _ in range(draw.randint(0, 7))]
        counts = [draw.choice([[0, 1], [1, 0], [1, 2, 0], [0, 1, 2]]) for _ in sizes]
        want = draw.randint(0, 300)
        got = mixing.nearest(sizes, counts, want)
        assert all(g in c for g, c in zip(got, counts, strict=True))
        every = [0]
        for n, c in zip(sizes, counts, strict=True):
            every = [x + n * k for x in every for k in c]
        assert abs(sum(n * g for n, g in zip(sizes, got, strict=True)) - want) == min(abs(x - want) for x in every)


@pytest.mark.parametrize("limits", [(64, 1 << 15, 100_000), (2, 50, 7)])
def test_repeated_rows_of_a_mix(spark, table, monkeypatch, limits):
    for name, value in zip(("NEAR", "SUMS", "LOT"), limits, strict=True):
        monkeypatch.setattr(mixing, name, value)
    table = table.selectExpr("*", "'p' AS pattern", "1 AS prio", "2 AS copies", "3 AS n", "map(1, doc_id) AS lot", "4 AS full", "5 AS `last`", "6 AS at", "7 AS number")
    marked = Counter()
    for r in mixing.mix(table).collect():
        marked[r.key, r.size] += r.copies
    out = mixing.repeat_rows(table)
    assert out.schema == table.schema
    rows = out.collect()
    got = Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in rows)
    assert got == +marked
    assert all((r.pattern, r.prio, r.copies, r.n, r.full, r.last, r.at, r.number) == ("p", 1, 2, 3, 4, 5, 6, 7) for r in rows)


def test_equal_rows_are_split_by_a_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LOT", 40)
    df = spark.range(300).selectExpr("1L AS doc_id", "'a b c' AS text", "if(id < 250, 'a', 'b') AS source", "id % 7 AS other")
    rows = mixing.mix(df).collect()
    taken = Counter()
    for r in rows:
        taken[r.pattern[0]] += r.taken
    assert len(rows) == 300
    for s in "ab":
        target = next(r.target for r in rows if r.pattern[0] == s)
        assert abs(taken[s] - target) <= 3
        copies = {r.copies for r in rows if r.pattern[0] == s}
        assert max(copies) - min(copies) <= 1
    out = mixing.repeat_rows(df).collect()
    assert Counter(r.source for r in out) == {s: n // 3 for s, n in taken.items()}
    assert len({r.other for r in out}) == 7


def test_documents_of_several_sources_meet_all_quotas(spark):
    """Overlapping sources: each source's quota is routed to it, and a pattern's words come from it alone."""
    draw = __import__("random").Random(8)
    member = [["a"], ["a", "b"], ["b", "c"], ["c"], ["a", "b", "c"]]
    rows = [(i, "w " * draw.randint(1, 40), draw.choice(member)) for i in range(3000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>")).collect()
    tokens, taken = Counter(), Counter()
    for r in out:
        tokens[tuple(r.pattern)] += r.size
        taken[tuple(r.pattern)] += r.taken
    sizes = Counter()
    for p, n in tokens.items():
        for s in p:
            sizes[s] += n
    quota = mixing.targets(dict(sizes))
    routed = mixing.route(dict(tokens), {s: round(x) for s, x in quota.items()}, 2)
    for p, n in taken.items():
        assert abs(sum(routed.get((p, s), 0) for s in p) - n) <= 0.001 * tokens[p] + 1
