"""Vector packing, leaderboards and the conversation trie against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pricewright.llm import conversation_trie, leaderboard, vector_packing

CLASH = ("bin", "chunk", "uid", "share", "day", "h", "depth", "part", "block", "own", "i", "k1", "n", "open", "base", "batch", "sent")


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})


# vector packing


def test_ids_equal_the_library_on_every_character():
    encoder = vector_packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not 0x20000 <= c < 0xE0000 and c < 0xF0000]
    texts = [f"a{chr(c)}b1{chr(c)}2 {chr(c)}!{chr(c)}{chr(c)} \n{chr(c)}" for c in points]
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "a", "the", "'s", "'", "é", "12", "!", "<|endoftext|>", "\t", "ing", "漢", "🦊", "　", "\x85", "<|endo", "aaaa", "́"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(20_000)]
    got = encoder.library.encode_batch(texts, add_special_tokens=False)
    assert [t for t, e in zip(texts, got) if encoder.text(t) != np.array(e.ids, "<u4").tobytes()] == []


def one_by_one(lengths, capacity, weights, score):
    whole, left, out = np.array(capacity), np.zeros((0, 3), int), []
    scale = np.array(weights) / whole.astype(float) ** 2
    for n in lengths:
        demand = np.array([n, 1, n * n])
        fits = np.flatnonzero((left >= demand).all(1))
        if len(fits):
            cost = left[fits] @ (demand * scale) if score == "dot" else ((left[fits] - demand) ** 2) @ scale
            b = fits[np.argmin(cost)]
        else:
            left, b = np.vstack([left, whole]), len(left)
        out.append((b, whole[0] - left[b, 0]))
        left[b] -= demand
    return out


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [(2048, 2048, 2048**2), (2048, 5, 2048**2), (2048, 2048, 1500**2)])
def test_best_fit_is_that_of_placing_one_by_one(score, capacity):
    rng = np.random.default_rng(7)
    lengths = np.sort(rng.integers(1, 1400, 700))[::-1]
    got = vector_packing.best_fit(lengths, capacity, (1.0, 0.3, 0.3), score)
    assert list(zip(*got)) == one_by_one(lengths, capacity, (1.0, 0.3, 0.3), score)


def test_a_piece_beyond_the_capacity_is_an_error():
    with pytest.raises(ValueError):
        vector_packing.best_fit(np.array([100]), (2048, 5, 50), (1, 1, 1), "norm")


ROWS = [(1, None), (2, ""), (2, "the same id"), (None, "no id"), (None, "no id"), (3, "alpha beta gamma " * 4000), (4, "x <|endoftext|> y"), *((i, f"text {i} " * (i % 90)) for i in range(10, 400))]


@pytest.mark.parametrize("keep", [True, False])
def test_vector_packing(spark, keep):
    docs = clashing(spark.createDataFrame(ROWS, "doc_id bigint, text string")).repartition(5)
    got = vector_packing.pack_vectors(docs, keep_ids=keep, documents=40, attention=1500**2 if not keep else None, window=2048 if keep else 1024, chunk_rows=150).collect()
    window = 2048 if keep else 1024
    encoder = vector_packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    expected = sorted((i is None, i or 0, [t for t in np.frombuffer(encoder.text(x), "<u4").tolist()] + [0]) for i, x in ROWS)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window and len(pieces) <= 40 and (keep or sum(r.length**2 for r in pieces) <= 1500**2)
    whole = sum(len(ids) for *_, ids in expected)
    assert sum(r.length for r in got) == whole and len(by) <= 1.1 * whole / window + 3 + len(ROWS) / 40
    crcs = []
    for *_, ids in expected:
        first = (len(ids) - 1) % window + 1
        cuts = [0, *range(first, len(ids) + 1, window)]
        crcs += [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(crcs) == sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got)
    if keep:
        assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)


def test_vector_packing_is_dense(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = vector_packing.pack_vectors(docs, keep_ids=False).toPandas()
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1


def test_vector_packing_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert vector_packing.pack_vectors(docs).collect() == [] and vector_packing.pack_vectors(docs, keep_ids=False).collect() == []


# leaderboard


def test_treap_against_a_sorted_list():
    rng = random.Random(1)
    treap, plain = leaderboard.Treap(np.zeros(0, np.int64), np.zeros(0, np.int64)), {}
    for turn in range(4000):
        item = rng.randrange(-40, 200)
        if rng.random() < 0.2:
            treap.drop(item)
            plain.pop(item, None)
        else:
            plain[item] = rng.choice([0, -5, 7, rng.randrange(-(10**12), 10**12)])
            treap.put(item, plain[item])
        order = sorted(plain, key=lambda i: (-plain[i], i))
        if turn % 50 == 0:
            assert treap.first(10) == [i for i in order if plain[i] > 0][:10] and treap.size[treap.root] == len(plain)
            assert [treap.rank(i) for i in order] == list(range(len(order)))
            revenue, items = treap.rows()
            assert items.tolist() == order
            again = leaderboard.Treap(leaderboard._from_planes(leaderboard._planes(revenue)), leaderboard._from_planes(leaderboard._planes(items)))
            assert again.first(10) == treap.first(10) and again.prio[again.root] == treap.prio[treap.root] == max(again.prio[1:], default=0)
            treap = again


def test_priorities_of_arrays_and_of_items_are_the_same():
    items = np.array([0, 1, -1, 2**62, -(2**63), 12345], np.int64)
    assert leaderboard.priorities(items).tolist() == [leaderboard.priority(i) for i in items.tolist()]


def boards(lines, vendors, items, batches=10):
    """The feed by a plain run through sorted lists."""
    nation, price, feed, revenue = {}, {}, [], defaultdict(lambda: defaultdict(int))
    for v, n in vendors:
        if v is not None and n is not None:
            nation[v] = min(n, nation.get(v, n))
    for i, p in items:
        price[i] = max((x for x in (p, price.get(i)) if x is not None), default=None)
    rows = []
    for sale, line, item, vendor, quantity, amount, flag, at in lines:
        h = zlib.crc32(",".join("" if x is None else str(x) for x in (sale, item, vendor, line)).encode())
        s = (at.date() - datetime(1970, 1, 1).date()).days if at else 19723 + h % 150
        a = s + h % 7 + (20 if h % 5 == 0 else 0)
        b = max(1, min(batches, 1 + (a - 19723) * batches // 180))
        if amount is not None and abs(amount) < 9e13:
            cents = int(np.floor(100 * amount + 0.5))
        elif quantity is not None and price.get(item) is not None:
            cents = quantity * int(np.floor(100 * price[item] + 0.5))
        else:
            cents = 0
        known = item is not None and item in price and nation.get(vendor) is not None
        rows.append((b, a, s, nation.get(vendor) if known else None, item, -cents if flag == "swapped" else cents))
    latest, last = None, defaultdict(list)
    for b in range(1, batches + 1):
        own = [r for r in rows if r[0] == b]
        for a in sorted({r[1] for r in own}):
            touched = set()
            for _, _, s, n, item, cents in (r for r in own if r[1] == a):
                if n is not None and (latest is None or s + 3 >= latest):
                    revenue[n][item] += cents
                    touched.add(n)
            for n in touched:
                now = [i for i in sorted(revenue[n], key=lambda i: (-revenue[n][i], i)) if revenue[n][i] > 0][:10]
                for i in {*now, *last[n]}:
                    old, new = (x.index(i) + 1 if i in x else None for x in (last[n], now))
                    if old != new:
                        feed.append((n, a, i, b, "enter" if old is None else "exit" if new is None else "move", old, new, revenue[n][i]))
                last[n] = now
        latest = max([r[2] for r in own] + ([] if latest is None else [latest]), default=None)
    return sorted(feed, key=str)


@pytest.mark.parametrize("share_items,fan,merge_every", [(4096, 128, None), (5, 2, 4)])
def test_leaderboard(spark, share_items, fan, merge_every):
    rng = random.Random(11)
    vendors = [(v, rng.randrange(3)) for v in range(8)] + [(8, None), (None, 1), (3, 2)]
    items = [(i, rng.choice([None, round(rng.random() * 50, 2)])) for i in range(30)] + [(4, 3.0), (None, 1.0)]
    lines = []
    for sale in range(700):
        at = datetime(2024, 1, 1) + timedelta(days=rng.randrange(150), hours=rng.randrange(24))
        lines.append((
            sale if rng.random() < 0.95 else None, rng.choice([1, 2, None]), rng.choice([7, rng.randrange(33), None]), rng.choice([2, rng.randrange(10), None]), rng.choice([1, 5, None]),
            rng.choice([None, float("nan"), float("inf"), 1e200, -3.5, *[round(rng.random() * 300, 2)] * 6]), rng.choice(["kept", "swapped", None]), rng.choice([None, *[at] * 8]),
        ))
    lines += lines[:40] + [(1, 1, 1, 1, 1, 5.0, "kept", datetime(2023, 6, 1)), (2, 1, 1, 1, 1, 5.0, "kept", datetime(2025, 6, 1))]
    kinds = "sale_id bigint, line_no int, item_id bigint, vendor_id bigint, quantity int, amount double, flag string, shipped_at timestamp_ntz"
    frames = (spark.createDataFrame(lines, kinds).repartition(3), spark.createDataFrame(vendors, "vendor_id bigint, nation_id int"), spark.createDataFrame(items, "item_id bigint, price double"))
    got = leaderboard.feed(spark, *map(clashing, frames), share_items=share_items, fan=fan, merge_every=merge_every)
    columns = ("nation_id", "arrival_day", "item_id", "batch", "change", "old_rank", "new_rank", "revenue")
    got, expected = {tuple(r) for r in got.select(*columns).collect()}, boards(lines, vendors, items)
    assert (sorted(got - {*expected}, key=str), sorted({*expected} - got, key=str)) == ([], []) and len(expected) > 100


def test_leaderboard_of_nothing(spark):
    lines = spark.createDataFrame([], "sale_id bigint, line_no int, item_id bigint, vendor_id bigint, quantity int, amount double, flag string, shipped_at timestamp_ntz")
    got = leaderboard.feed(spark, lines, spark.createDataFrame([(1, 1)], "vendor_id bigint, nation_id int"), spark.createDataFrame([(1, 1.0)], "item_id bigint, price double"), batches=2)
    assert got.collect() == []


# conversation trie


def nodes_of(paths):
    """The nodes of {conversation: sequence of (role, text)}, by walking every prefix."""
    members = defaultdict(list)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = []
    for p, m in members.items():
        todo, leaves, saved = [p], 0, 0
        while todo:
            q = todo.pop()
            leaves += not children[q]
            saved += (len(members[q]) - 1) * (len(q[-1][1]) if q else 0)
            todo += children[q]
        ends = ",".join(map(str, sorted(c for c in m if len(paths[c]) == len(p))))
        above = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), above, len(m), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
KINDS = "conv_id bigint, turn bigint, role string, text string"


def ordered(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns, key=lambda t: t[:3])] for c, turns in by.items()}


def some_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-3, 60), *range(100, 130), 205, 10**12]:
        rows += [(c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "bb", "🦊", "", None])) for t in range(rng.randint(1, 7))]
    rows += [(9, None, "user", "first"), (None, 0, "user", "lost"), (50, 3, "a", "tie"), (50, 3, "b", "tie"), (50, 3, "b", "tie")]
    rng.shuffle(rows)
    return rows


def test_trie(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "BLOCK", 3)
    monkeypatch.setattr(conversation_trie, "END_IDS", 4)
    rows = [r for r in some_rows(2) if not (r[0] == 50 and r[3] != "tie")]  # equal turns of unlike texts have an order by hash
    got = conversation_trie.prefix_trie(clashing(spark.createDataFrame(rows, KINDS).repartition(6))).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=str) == nodes_of(ordered(rows))


def test_trie_of_rebuilt_conversations(spark):
    rows = [r for r in some_rows(3) if r[0] != 50]
    paths, made = ordered(rows), {}
    for c, own in paths.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        made[c] = paths.get(base, [])[:h] + own[h:]
    turns, convs = conversation_trie.rebuilt(conversation_trie.ordered(spark.createDataFrame(rows, KINDS)))
    got = conversation_trie.trie(turns, convs).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=str) == nodes_of(made)


def test_trie_of_copies_and_of_a_long_conversation(spark):
    rows = [(c, t, "user", f"text {t}") for c in range(300) for t in range(3)] + [(1000 + k, t, "user", str(t)) for k in range(2) for t in range(4000)]
    got = conversation_trie.prefix_trie(spark.createDataFrame(rows, KINDS)).select(*COLUMNS).collect()
    by = {(r.conv_id, r.depth): r for r in got}
    assert len(got) == 1 + 3 + 4000 and by[0, 0].n_children == 2 and by[0, 0].n_leaves == 2 and by[0, 0].n_convs == 302
    assert by[0, 3].ends_sha256 == hashlib.sha256(",".join(map(str, range(300))).encode()).hexdigest() and by[0, 3].saved_tokens == 299 * 6
    assert by[1000, 4000].n_children == 0 and by[1000, 1].saved_tokens == sum(len(str(t)) for t in range(4000)) and by[1000, 1].parent_conv_id == 0


def test_trie_of_nothing(spark):
    assert conversation_trie.prefix_trie(spark.createDataFrame([], KINDS)).collect() == []
    assert conversation_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], KINDS)).collect() == []
