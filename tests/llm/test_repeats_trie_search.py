"""Repeated passages, conversation tries and lexical search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import lexical_search, prefix_trie, run_index, suffix_dedup
from millrace.llm.queries import queries

CLASH = [("doc", "long"), ("crc", "long"), ("n", "int"), ("start", "int"), ("bucket", "int"), ("item", "int"), ("score", "int"), ("conv", "long"), ("key", "int")]


def clashing(df):
    return df.withColumns({c: F.lit(1).cast(t) for c, t in CLASH})


# 11 ----------------------------------------------------------------------------------------


def packed(texts):
    size = np.array([len(t) for t in texts])
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size


def test_matching_statistics_equal_the_plain_search():
    r = random.Random(1)
    for _ in range(150):
        letters = r.choice([b"a", b"ab", b"abcd"])
        text = lambda: bytes(r.choice(letters) for _ in range(r.randrange(1, 40)))  # noqa: B023, E731
        base = [text() for _ in range(r.randrange(1, 8))]
        base += [base[0]] * r.randrange(3)
        asked = [text() for _ in range(6)] + [base[0][1:] + b"b", base[-1]]
        tags, own = np.array([r.randrange(3) for _ in base]), np.array([r.randrange(4) for _ in asked])
        want = []
        for q, t in zip(asked, own, strict=True):
            held = [b for b, g in zip(base, tags, strict=True) if g == t]
            for i in range(len(q)):
                want.append(max((n for n in range(len(q) - i + 1) if any(q[i : i + n] in b for b in held)), default=0))
        got = run_index.RunIndex(*packed(base), tags).matching(*packed(asked), own)
        assert got.tolist() == want


def test_a_repetitive_corpus_has_few_runs():
    r = random.Random(2)
    base = bytes(r.choice(b"abcdefgh") for _ in range(400))
    index = run_index.RunIndex(*packed([base] * 50), np.zeros(50, np.int64))
    assert index.runs < 1_000  # of 20,050 symbols


def removed(docs, size=100):
    """By (id, text): what is left when each string is looked up in all that stands before it."""
    out, seen = {}, set()
    for i, t in sorted(set(docs), key=lambda x: (x[0] is None, x[0] or 0, zlib.crc32((x[1] or "").encode()))):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if b[s : s + size] in seen:
                gone[s : s + size] = b"\1" * size
            seen.add(b[s : s + size])
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out[i, t] = (i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def passages():
    r = random.Random(5)
    words = ["ab", "cde", "f", "ghij", "klmno", "é", "日本", "xyz ", "q"]
    say = lambda n: " ".join(r.choice(words) + r.choice(words) for _ in range(n))
    common, docs = [say(40) for _ in range(5)], []
    for k in range(160):
        parts = [say(r.randrange(1, 30)) for _ in range(r.randrange(1, 4))]
        for _ in range(r.randrange(3)):
            p = r.choice(common)
            p = p[(a := r.randrange(30)) : a + r.randrange(60, 200)]
            parts.insert(r.randrange(len(parts) + 1), p if r.random() < 0.7 else p[:70] + "Z" + p[71:])
        docs.append((k, " ".join(parts)))
    docs += [(k + 300, docs[k][1]) for k in range(30)]
    docs += [(900, "x" * 700), (901, "xy" * 400), (902, None), (903, ""), (904, "short"), (5, docs[5][1]), (5, docs[6][1] + "tail"), (None, docs[7][1]), (None, "y" * 150 + docs[9][1])]
    return docs + [(905, say(30_000)), (906, (say(20) + "\n") * 40)]


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 6, 2])
def test_repeats_equal_brute_force(spark, hot):
    docs = passages()
    got = suffix_dedup.dedup(clashing(spark.createDataFrame(docs, "doc_id long, text string")).repartition(5), hot=hot).collect()
    want = removed(docs)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == Counter(want[d] for d in docs)
    assert all(hashlib.sha256(r["kept_text"]).hexdigest() == r["kept_sha256"] for r in got)


def test_stretches_hold_every_start_once_and_across_slices(monkeypatch):
    r = random.Random(9)
    texts = [bytes(r.choice(b"ab ") for _ in range(r.choice([0, 99, 100, 101, 500, 3000]))) for _ in range(30)]
    data, starts, size = packed(texts)
    for piece in (suffix_dedup.PIECE, 333):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        s = suffix_dedup.stretches(data, np.append(starts, len(data)))
        held = Counter((int(row), int(a) + j) for row, a, n in zip(s.row, s.start, s.n, strict=True) for j in range(n))
        assert held == Counter((k, a) for k, z in enumerate(size) for a in range(z - 99))
        for row, a, n, off in zip(s.row, s.start, s.n, s.off, strict=True):
            assert 0 <= off - n + 1 and off <= 100 - suffix_dedup.GRAM and n > 0 and a + n - 1 + 100 <= size[row]


def test_no_documents_no_repeats(spark):
    assert suffix_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError, match="size"):
        suffix_dedup.dedup(spark.createDataFrame([], "doc_id long, text string"), size=20)


# 12 ----------------------------------------------------------------------------------------


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]), (role, text)))
    said = {c: [v for _, v in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(said.get(c - int(math.fmod(c, 100)), [])[:h] + said[c][h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                kids[turns[: d - 1]].add(turns[:d])
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in kids[p])
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(rebuilt[c]) == len(p)))).encode()).hexdigest()
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], ends(p)) for p, m in members.items())


def talks():
    r = random.Random(4)
    say = lambda: r.choice([r.choice("abc") + "é" * r.randrange(3), None])
    rows = []
    for c in [*range(100), *range(101, 260), *range(1000, 1150), -5, -100, -101]:
        if 1000 <= c < 1100:
            turns = [("user", "hi"), ("assistant", "yo")]
        else:
            turns = [(r.choice(["user", "assistant", None]), say()) for _ in range(r.randrange(9))]
        rows += [(c, k, who, text) for k, (who, text) in enumerate(turns)]
    rows += [(190, k, "user", "long " * 2000) for k in range(20, 60)]
    return rows + [(5, None, "user", "first"), (6, 2, "x", "tie"), (6, 2, "x", "tie"), (None, 1, "a", "b"), (155, 0, "user", "only")]


@pytest.mark.parametrize("ranges", [0, 1, 40, 300])
def test_trie_equals_brute_force(spark, ranges):
    rows = talks()
    table = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).repartition(5)
    got = prefix_trie.trie(prefix_trie.shared_heads(prefix_trie.sequences(table)), ranges).collect()
    assert Counter(map(tuple, got)) == brute_trie(rows)


def test_long_ends_pass_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ENDS_BYTES", 60)
    rows = [(k, 0, "user", "same") for k in range(100)]
    entries = [(b"k" * prefix_trie.DIGEST, k, [4], int(k > 0)) for k in range(100)]
    parts = [r for span, part in enumerate((entries[:40], entries[40:])) for r in prefix_trie.nodes(iter(part), span, *((-1, 1), (1, -1))[span]) if r[8]]
    assert len(parts) > 30
    table = spark.createDataFrame([(r[9], r[8], r[11], r[12]) for r in parts], "node string, ends string, span int, nth int")
    assert [r["ends_sha256"] for r in prefix_trie._ends(table).collect()] == [hashlib.sha256(",".join(str(r[0]) for r in rows).encode()).hexdigest()]


def test_merge_compares_no_shared_turn_again(monkeypatch):
    r = random.Random(8)
    entries = sorted((b"".join(bytes([r.randrange(2)]) * prefix_trie.DIGEST for _ in range(r.randrange(30))), k) for k in range(400))
    runs, asked = [], []
    for k in range(7):
        part = entries[k::7]
        runs.append(prefix_trie.Run([e[0] for e in part], [e[1] for e in part], [[1] * (len(e[0]) // prefix_trie.DIGEST) for e in part], [prefix_trie.lcp(part[j - 1][0], e[0]) if j else 0 for j, e in enumerate(part)]))
    plain = prefix_trie.lcp
    monkeypatch.setattr(prefix_trie, "lcp", lambda a, b, start=0: asked.append(plain(a, b, start) - start) or plain(a, b, start))
    got = list(prefix_trie.merge(runs))
    assert [g[:2] for g in got] == entries
    assert [g[3] for g in got[1:]] == [plain(a[0], b[0]) for a, b in zip(entries, entries[1:], strict=False)]
    turns = sum(len(e[0]) // prefix_trie.DIGEST for e in entries)
    assert sum(asked) <= turns  # each turn of a conversation is found shared at most once
    assert list(prefix_trie.merge([])) == [] and list(prefix_trie.merge([prefix_trie.Run([], [], [], [])])) == []


def test_no_conversations_no_nodes(spark):
    assert prefix_trie.trie(prefix_trie.shared_heads(prefix_trie.sequences(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))).count() == 0


# 13 ----------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, k=50):
    found = lambda t: TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, c) for i, c in ((i, Counter(found(t))) for i, t in docs) if c]
    number, total = len(held), sum(sum(c.values()) for _, c in held)
    df, out = Counter(x for _, c in held for x in c), Counter()
    for item, t in items:
        scores = []
        for i, c in held:
            m = 50 + (50 * sum(c.values()) * number) // total
            score = sum(math.floor(1000 * math.log((2 * number + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 20 * m)) for x in set(found(t)) if x in c)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out.update((item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k]))
    return out


def hits():
    r = random.Random(3)
    words = ["ab", "Cd", "é1", "日本", "x9", "q", "the", "of", "zz", "K"] + [f"w{k}" for k in range(60)]
    say = lambda n: r.choice([" ", "-", "_", ", "]).join(r.choice(words) for _ in range(n))
    docs = [(k, say(r.randrange(40))) for k in range(300)] + [(k, "ab Cd x9 zz") for k in range(300, 420)]
    docs += [(None, "ab cd é1"), (None, None), (7, "ab"), (1000, ""), (1001, "ab " * 50_000), ((1 << 53) + 1, "ab Cd x9 zz")]
    return docs, [(k, say(r.randrange(12))) for k in range(25)] + [(3, "ab cd"), (90, None), (91, ""), (92, "unknownterm"), (None, "é1 é1 q"), (93, "é1 cd")]


@pytest.mark.parametrize("block", [lexical_search.BLOCK_BYTES, 150])
def test_search_equals_brute_force(spark, block):
    docs, items = hits()
    got = lexical_search.search(clashing(spark.createDataFrame(docs, "doc_id long, text string")).repartition(5), clashing(spark.createDataFrame(items, "item_id long, text string")), block_bytes=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == brute_search(docs, items)


def test_radix_order_is_a_sort():
    keys = np.array([random.Random(k).randrange(1 << 40) for k in range(5000)], np.uint64)
    assert (keys[lexical_search.radix_order(keys)] == np.sort(keys)).all()
    assert len(lexical_search.radix_order(keys[:0])) == 0


def test_nothing_to_search(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0


def test_all_three_are_registered():
    assert {"op11_suffix_array_dedup", "op12_prefix_trie", "op13_lexical_search"} <= set(queries())


# 2, 8 --------------------------------------------------------------------------------------


def test_held_out_documents_get_their_language(spark):
    """The network learns from windows that the executors cut; here is what it makes of the fold that it has not seen."""
    from millrace.llm import language_id

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").repartition(4)
    net = language_id.train(docs.filter(~language_id.held_out()))
    found = language_id.predict(docs.filter(language_id.held_out()), net, keep=("lang",)).filter("lang IS NOT NULL AND lang_pred <> 'und'")
    right, n = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 100 and right >= 0.97 * n, (right, n)


@pytest.mark.parametrize("per_bucket", [1, 7, 5_000])
def test_packing_places_all_pieces_of_a_length_in_any_number_of_buckets(spark, per_bucket):
    from millrace.llm import packing

    r = random.Random(per_bucket)
    rows = [(k, 0, 0, r.choice([3, 3, 3, 5, 8, 16, r.randrange(1, 17)]), k * 7) for k in range(400)]
    found = spark.createDataFrame(rows, "id long, piece int, start long, length long, ids_crc32 long").repartition(3)
    got = packing.pack(found, 16, per_bucket).collect()
    held = defaultdict(list)
    for x in got:
        held[x["sequence_id"]].append((x["offset"], x["length"]))
    assert sorted(x["id"] for x in got) == list(range(400))
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 16
    rooms = []
    for n in sorted((x[3] for x in rows), reverse=True):  # best-fit decreasing, one by one
        fit = min((x for x in rooms if x >= n), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((16 if fit is None else fit) - n)
    assert len(held) == len(rooms)
