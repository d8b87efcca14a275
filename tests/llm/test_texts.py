import collections
import itertools
import random
import re

import numpy as np
import pytest

from threadloom.llm import omh, queries, spans, split
from threadloom.llm.bpe import WORDS, token_counts, token_ids, vocabulary
from threadloom.llm.grid import groups, union_find
from threadloom.llm.omh import member_pairs, near_duplicates
from threadloom.llm.packing import pack, place_runs
from threadloom.llm.split import boundary, pieces, split_texts
from threadloom.session import Scratch

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def words(rng, n, of=4000):
    return [f"w{rng.randrange(of)}" for _ in range(n)]


# splitting


def test_pieces_cover_the_text():
    rng = random.Random(1)
    parts = ["a", "b. ", "c! ", "\n", "\n\n", "\r\n", "\r\n\r\n", " ", "\t", "# x\n", "```\n", "\n  \n", "wordword", "x" * 30, "é", "👍"]
    for _ in range(400):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 200)))
        limit = rng.randint(5, 80)
        over = rng.randint(0, limit - 1)
        got = pieces(s, limit, over)
        assert all(0 < b - a <= limit for a, b in got)
        if s:
            assert got[0][0] == 0 and got[-1][1] == len(s)
            assert all(x[0] < y[0] <= x[1] < y[1] and x[1] - y[0] <= over for x, y in zip(got, got[1:]))


def test_boundaries():
    p = "x" * 8
    assert boundary(f"{p}\n\n{p}", 8) == "paragraph" and boundary(f"{p}\r\n \t\r\n{p}", 8) == "paragraph"
    assert boundary(f"{p}\r\n{p}", 8) == "line" and boundary(f"{p}\r{p}\n{p}", 8) == "line"
    assert boundary(f"{p[:-1]}. {p}", 8) == "sentence" and boundary(f"{p} {p}", 8) == "word" and boundary(p + p, 8) == "none"
    assert boundary(f"{p[:-1]}.{p}", 9) == "none" and boundary(" " * 50, 8) == "paragraph"


def test_packing_prefers_structure():
    text = "# A\n" + "a" * 20 + "\n\n# B\n" + "b" * 20 + "\n\n" + "b" * 20
    assert [text[a:b] for a, b in pieces(text, 32, 0)] == ["# A\n" + "a" * 20 + "\n\n", "# B\n" + "b" * 20 + "\n\n", "b" * 20]
    with pytest.raises(ValueError, match="overlap"):
        pieces("x", 5, 5)


def test_the_tree_decides_the_boundary():
    def by_definition(text, limit):
        for level in split.LEVELS:
            edges = [0, *split.cuts(text, level), len(text)]
            if all(len(text[a:b].strip(" \t\r\n")) <= limit for a, b in zip(edges, edges[1:])):
                return level
        return "none"

    rng = random.Random(21)
    parts = ["a", "b. ", "c! ", "\n", "\n\n", "\r\n", "\r\n\r\n", " ", "# x\n", "## y\n", "```\n", "\n \n", "wordword", "x" * 30, "- i\n", "  - j\n", "| a |\n", "1. z\n", "<h2>q</h2>\n"]
    for _ in range(600):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 200)))
        limit = rng.randint(5, 80)
        if len(s) > limit:
            assert boundary(s, limit) == split.cut_text(s, limit, rng.randint(0, limit - 1))[1] == by_definition(s, limit)


def test_paragraphs_within_the_limit_are_not_cut():
    text = "\n\n".join("word " * n for n in (1170, 1170, 40, 30, 1190, 20))
    starts = {0, *split.cuts(text, "paragraph")}
    got, level = split.cut_text(text, 6000, 300)
    assert level == "paragraph" and {e for _, e in got[:-1]} <= starts and max(e - s for s, e in got) <= 6000


def test_pieces_cross_headings_only_with_whole_sections():
    text = "".join(f"# {n}\n\n" + "\n\n".join(c * 60 for c in n * k) + "\n\n" for n, k in (("a", 9), ("b", 1), ("c", 1), ("d", 9)))
    heads = [m.start() for m in re.finditer("# ", text)]
    got = pieces(text, 300, 0)
    for s, e in got:
        inside = [h for h in heads if s < h < e]
        assert not inside or (s in heads and (e in heads or e == len(text)))
    assert (heads[1], heads[3]) in got
    listed = "- one\n" + "  - two words here\n" * 12 + "- three\n" + "  - four\n" * 3
    assert all(listed[s:e].startswith(("-", "  -")) for s, e in pieces(listed, 60, 0)) and listed.index("- three") in {s for s, _ in pieces(listed, 60, 0)}
    assert max(e - s for s, e in pieces("".join(" " * i + "- it\n" for i in range(300)), 100, 10)) <= 100


def test_split_rows(spark):
    df = spark.createDataFrame([(1, "aaaa bbbb", "x"), (2, None, "y"), (3, "", "z"), (4, "short", "z"), (None, "cccc\ndddd", "q")], "id long, body string, content string")
    got = split_texts(df, "id", "body", 6, 1).collect()
    assert {(r.id, r.boundary, r.piece) for r in got} == {(1, "word", 0), (1, "word", 1), (None, "line", 0), (None, "line", 1)}
    assert split_texts(df.limit(0), "id", "body", 6, 1).count() == 0


# grid components


def test_groups_against_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, i) for i in range(1001, 1400)] + [(i, i + 1) for i in range(2000, 2300)] + [(5, 5), (None, 7), (8, None)]
    edges += edges[:50] + [(b, a) for a, b in edges[:50]]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "x long, y long")
    for cell in (40, 10**6):  # many cells in each round, and the least number
        assert {tuple(r) for r in groups(df, "x", "y", Scratch(spark), cell).collect()} == {(find(v), v) for v in list(parent)}
    assert groups(df.limit(0), "x", "y", Scratch(spark)).count() == 0


def test_hubs_are_relabelled_apart(spark, monkeypatch):
    monkeypatch.setattr("threadloom.llm.grid.HUB", 20)
    edges = [(7, i) for i in range(100, 400)] + [(i, i + 1) for i in range(1000, 1030)] + [(5, 100), (-3, 1030)]
    got = {tuple(r) for r in groups(spark.createDataFrame(edges, "x long, y long"), "x", "y", Scratch(spark), 60).collect()}
    assert got == {(5, v) for v in [5, 7, *range(100, 400)]} | {(-3, v) for v in [-3, *range(1000, 1031)]}


def test_local_union_find():
    vertex, root = union_find(np.array([5, 3, 9]), np.array([3, 1, 9]))
    assert dict(zip(vertex.tolist(), root.tolist())) == {1: 1, 3: 1, 5: 1, 9: 9}


# near duplicates


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return set(zip(w, w[1:], w[2:]))


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(25):
        base = words(rng, rng.randint(30, 120))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            edit = list(base)
            for _ in range(rng.randint(0, 4)):
                edit[rng.randrange(len(edit))] = "Edit%d" % rng.randrange(99)
            if rng.random() < 0.5:
                k = rng.randrange(len(edit))
                edit = edit[k:] + edit[:k]
            texts.append(", ".join(edit))
    texts += [None, "", "a b c", texts[0], texts[0].upper(), "x " * 500]
    rows = [("t" if i % 2 else "u", i // 2, t, 1) for i, t in enumerate(texts)] + [("t", None, texts[0], 1), (None, 1, texts[0], 1)]
    df = spark.createDataFrame(rows, "name string, id long, text string, kind int")
    pairs, members = near_duplicates(df, 0.6, Scratch(spark))
    got = {tuple(r) for r in member_pairs(pairs, members).collect()}
    want = set()
    keep = [(n, i, shingles(t)) for n, i, t, _ in rows if n and i is not None]
    for a in range(len(keep)):
        for b in range(a):
            (n, i, s), (m, j, t) = keep[a], keep[b]
            if n == m and min(len(s), len(t)) >= 20 and len(s & t) >= 0.6 * len(s | t):
                want.add((n, min(i, j), max(i, j)))
    assert got == want and len(want) > 10
    pairs, members = near_duplicates(df.limit(0), 0.6, Scratch(spark))
    assert member_pairs(pairs, members).count() == 0


def test_crowded_bands_are_joined_exactly(spark):
    rng = random.Random(4)
    boiler = words(rng, 80)
    texts = [" ".join(boiler + words(rng, 120)) for _ in range(30)] + [" ".join(boiler + words(rng, 5)) for _ in range(12)]
    df = spark.createDataFrame([("t", i, t) for i, t in enumerate(texts)], "name string, id long, text string")
    got = [{tuple(r) for r in member_pairs(*near_duplicates(df, 0.6, Scratch(spark), hot=hot)).collect()} for hot in (3, 64)]
    assert got[0] == got[1] == {("t", i, j) for i in range(30, 42) for j in range(i + 1, 42)}


def test_lines_repeated_a_different_number_of_times(spark):
    rng = random.Random(22)
    line = " ".join(words(rng, 10))
    texts = [" ".join([*([line] * n), *body]) for body in (words(rng, 60) for _ in range(12)) for n in (10, 100)]
    df = spark.createDataFrame([("t", i, t) for i, t in enumerate(texts)], "name string, id long, text string")
    got = {tuple(r) for r in member_pairs(*near_duplicates(df, 0.6, Scratch(spark))).collect()}
    assert got == {("t", i, i + 1) for i in range(0, 24, 2)}


def test_alignment_counts_words_in_order():
    a, b = np.array([[1, 2, 3, 4, 5, 6]]), np.array([[9, 1, 2, 4, 5, 7, 6]])
    got = omh.aligned(a, b, np.array([6]), np.array([7]), np.array([1]), 8)
    assert got.tolist() == [5]
    assert omh.aligned(a, a, np.array([6]), np.array([6]), np.array([0]), 3).tolist() == [6]


# tokenizer


def test_ids_equal_the_public_tokenizer(spark):
    assert WORDS == public_tokenizers.PATTERN
    t = tokenizers.Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    rng = random.Random(5)
    texts = [None, "", " ", "\n\n \t x", "<|endoftext|>hi", "👍🏽 naïve 测试 тест", "a" * 5000, "abab" * 900, " " * 300, "it's we'll 123456 don't"]
    texts += ["".join(rng.choice("abc é1. \n'sз") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(i, t_, "c") for i, t_ in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in token_ids(df, "doc_id", "text", BPE).collect()}
    want = [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert got == dict(enumerate(want))
    assert {r.doc_id: r.n_tokens for r in token_counts(df, "doc_id", "text", BPE).collect()} == {i: len(w) for i, w in enumerate(want)}
    assert token_ids(df.limit(0), "doc_id", "text", BPE).count() == 0


def test_overlapping_merges():
    v = vocabulary(BPE)
    for n in range(1, 40):
        t = tokenizers.Tokenizer.from_file(BPE)
        assert v.encode(["a" * n])[0].tolist() == t.encode("a" * n, add_special_tokens=False).ids


# packing


def test_runs_are_placed_once_and_fit():
    rng = random.Random(6)
    for _ in range(200):
        cap = rng.randint(1, 60)
        counts = {rng.randint(1, cap): rng.randint(1, 30) for _ in range(rng.randint(0, 12))}
        plan, opened = place_runs(counts, cap)
        used, seen = np.zeros(opened, int), collections.defaultdict(list)
        for size, first, n, box in plan:
            used[box : box + n] += size
            seen[size] += range(first, first + n)
        assert all(sorted(seen[s]) == list(range(n)) for s, n in counts.items())
        assert opened == 0 or (used.max() <= cap and used.min() > 0)
        assert opened <= 1.25 * max(1, -(-sum(s * n for s, n in counts.items()) // cap)) + 1 or max(counts) * 3 > cap


@pytest.mark.parametrize("ranked", [10**6, 7])
def test_pack(spark, monkeypatch, ranked):
    monkeypatch.setattr("threadloom.llm.packing.RANKED", ranked)
    rng = random.Random(7)
    sizes = [0, None, 10, 20, 25, 30, 100] + [rng.randint(1, 12) for _ in range(80)] + [3] * 40
    rows = [(i, s, "x") for i, s in enumerate(sizes)] + [(3, 20, "again"), (None, 4, "lost")]
    got = pack(spark.createDataFrame(rows, "id long, n long, piece string"), "id", "n", 10).collect()
    box = collections.defaultdict(int)
    for r in got:
        box[r.container_id] += r.n_units
    assert max(box.values()) <= 10 and sorted(box) == list(range(len(box)))
    total = sum(s or 0 for s in sizes) + 20
    assert sum(box.values()) == total and len(box) <= total / 10 * 1.1 + 1
    assert sorted((r.piece, r.first_unit, r.n_units) for r in got if r.id == 4) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]
    assert all(r.piece == 0 for r in got if sizes[r.id] is not None and sizes[r.id] <= 10)
    assert sum(r.id == 0 for r in got) == 1 and sum(r.id == 1 for r in got) == 1 and sum(r.id == 3 for r in got) == 4
    assert pack(spark.createDataFrame([], "id long, n long"), "id", "n", 10).count() == 0


# shared spans


def shared_by_brute_force(docs, length):
    seen = collections.defaultdict(set)
    for d, t in docs:
        for i in range(len(t or "") - length + 1):
            seen[t[i : i + length]].add(d)
    cover = collections.defaultdict(set)
    for d, t in docs:
        for i in range(len(t or "") - length + 1):
            if len(seen[t[i : i + length]]) > 1:
                cover[d] |= set(range(i, i + length))
    return {d: len(c) for d, c in cover.items()}


@pytest.mark.parametrize("hot", [24, 2])
def test_shared_amounts_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(spans, "HOT", hot)
    rng = random.Random(8)
    letters = "abcdé 测👍\n"
    blocks = ["".join(rng.choice(letters) for _ in range(rng.randint(10, 60))) for _ in range(12)]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            b = rng.choice(blocks)
            k = rng.randint(0, 8)
            parts += [b[k:], "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))]
        docs.append((i, "".join(parts)))
    docs += [(100, None), (101, ""), (102, docs[3][1]), (103, docs[3][1]), (104, "zq" * 60), (105, "qz" * 50), (106, blocks[0] * 3), (None, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc: r.shared_chars for r in spans.shared_amounts(df, "doc_id", "text", 30, Scratch(spark)).collect()}
    assert got == shared_by_brute_force([d for d in docs if d[0] is not None], 30)
    assert spans.shared_amounts(df.limit(0), "doc_id", "text", 30, Scratch(spark)).count() == 0


def test_repeated_document_is_one(spark):
    text = "".join(random.Random(9).choice("abcdef") for _ in range(80))
    df = spark.createDataFrame([(1, text), (1, text), (1, text + "x" * 5)], "doc_id long, text string")
    assert spans.shared_amounts(df, "doc_id", "text", 30, Scratch(spark)).count() == 0


def test_long_texts_have_the_same_seeds():
    chars = np.random.default_rng(1).integers(0, 4, 30_000).astype(np.uint32)
    a, b = spans.text_seeds(chars, 20, 11), spans.text_seeds(chars, 20, 11, portion=700)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_chains_keep_order():
    a, b, n = np.array([0, 100, 200, 50]), np.array([500, 600, 700, 0]), np.array([40, 40, 40, 30])
    c = spans.chain(a, b, n)
    assert c[0] == c[1] == c[2] != c[3]


def edited(text, step):
    return "".join("#" if i % step == step - 1 else c for i, c in enumerate(text))


def test_passages_with_small_edits(spark, tmp_path):
    rng = random.Random(12)
    base = "".join(rng.choice("abcdefgh ") for _ in range(600))
    short = "".join(rng.choice("abcdefgh ") for _ in range(120))
    docs = [(1, "x" * 9 + base), (2, edited(base, 120) + "y"), (3, short + "z"), (4, "w" + short + "w" * 40)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    (r,) = queries.p9_passages(spark, str(tmp_path)).collect()
    assert (r.left_id, r.right_id, r.n_spans, r.matched_chars) == (1, 2, 5, 5 * 119)
    assert (r.left_start, r.left_end, r.right_start, r.right_end) == (9, 608, 0, 599)


def test_passages_with_gaps_are_aligned(spark, tmp_path):
    rng = random.Random(15)
    base = "".join(rng.choice("abcdefgh ") for _ in range(900))
    cut = base[:300] + base[340:]  # 40 characters left out, then 30 put in
    other = "q" * 7 + cut[:500] + "#" * 30 + cut[500:]
    swapped = base[600:] + base[:300]
    docs = [(1, base), (2, other), (3, swapped + "z" * 9)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = {(r.left_id, r.right_id, r.left_start): r for r in queries.p9_passages(spark, str(tmp_path)).collect()}
    whole = rows[1, 2, 0]
    assert (whole.left_end, whole.right_start, whole.right_end, whole.n_spans) == (900, 7, 7 + 890, 3) and whole.matched_chars == 860 and whole.identity == round(860 / 900, 4)
    assert {k[2] for k in rows if k[:2] == (1, 3)} == {0, 600} and all(rows[k].identity == 1 for k in rows if k[:2] == (1, 3))
    noisy = "".join(c if i % 9 else "#" for i, c in enumerate(base[300:420]))
    spark.createDataFrame([(1, base), (2, base[:300] + noisy + base[420:])], "doc_id long, text string").write.parquet(f"file://{tmp_path}/noisy/documents.parquet")
    (r,) = queries.p9_passages(spark, f"{tmp_path}/noisy").collect()
    assert r.n_spans == 2 and r.left_end == r.right_end == 900 and 870 <= r.matched_chars <= 890  # the stretch between is aligned


def test_passages_of_hot_spans_cover_all_documents(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(spans, "HOT", 2)
    rng = random.Random(13)
    base = "".join(rng.choice("abcdefgh ") for _ in range(160))
    docs = [(1, base[:110] + "q" * 60), (2, "r" * 60 + base[50:])] + [(i, base + chr(60 + i) * i) for i in range(3, 9)] + [(9, "t" * 60 + base[30:140])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = queries.p9_passages(spark, str(tmp_path)).collect()
    assert {i for r in rows for i in (r.left_id, r.right_id) if r.matched_chars >= 150} == set(range(3, 9))


@pytest.mark.parametrize("hot", [24, 2])
def test_passages_of_hot_seeds_between_all_documents(spark, monkeypatch, tmp_path, hot):
    monkeypatch.setattr(spans, "HOT", hot)
    rng = random.Random(16)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    base, first, second, tail = make(160), make(100), make(100), make(90)
    docs = [(i, make(5 + i) + base) for i in range(1, 7)]  # every two have the whole span
    docs += [(i, make(9 + i) + first + "#" * i + tail) for i in (11, 12)] + [(i, make(7 + i) + first + make(30)) for i in (10, 13, 14)]  # a hot seed, and one that is not
    docs += [(i, make(9 + i) + first + "$" * (i - 20) + second) for i in (21, 22, 23)]  # two hot seeds
    docs += [(i, make(4) + "ab" * (200 + i) + make(40)) for i in (31, 32, 33)]  # repeats inside a document
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = queries.p9_passages(spark, str(tmp_path)).collect()
    pairs = {(r.left_id, r.right_id) for r in rows}
    whole = lambda ids: set(itertools.combinations(ids, 2))
    assert pairs == whole(range(1, 7)) | {(11, 12)} | whole((21, 22, 23)) | whole((31, 32, 33))
    assert max(r.matched_chars for r in rows if (r.left_id, r.right_id) == (32, 33)) >= 464
    monkeypatch.setattr(spans, "HOT", 10**9)  # every pair of occurrences
    plain = queries.p9_passages(spark, str(tmp_path)).drop("class_id").collect()
    assert sorted(r[:-1] for r in rows) == sorted(tuple(r) for r in plain)


def test_passages_tell_copies_and_classes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(spans, "HOT", 2)
    rng = random.Random(14)
    one, two, own = ("".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(3))
    docs = [(i, chr(60 + i) * i + one) for i in range(6)] + [(i, two) for i in (10, 11, 12)] + [(13, two + "z"), (14, own), (15, own), (16, "p" * 200 + "s" * 9)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = queries.p9_passages(spark, str(tmp_path)).collect()
    members = collections.defaultdict(set)
    for r in rows:
        members[r.class_id] |= {r.left_id, r.right_id}
    assert sorted(map(sorted, members.values())) == [[0, 1, 2, 3, 4, 5], [10, 11, 12, 13], [14, 15]]
    assert {(r.left_id, r.right_id, r.matched_chars) for r in rows if r.left_id >= 10} == {(10, 11, 200), (10, 12, 200), (10, 13, 200), (14, 15, 200)}


def test_marks_tell_hopeless_candidates():
    rng = np.random.default_rng(10)
    least = omh.least_marks(0.6, omh.BANDS)
    for shared, alike in ((150, True), (20, False)):
        agree = []
        for _ in range(30):
            key = rng.integers(1, 2**62, 350 - shared).astype(np.uint64)
            both = np.concatenate([key[:shared], key[shared : shared + (350 - 2 * shared) // 2 + shared // 2], key[:shared], key[shared + (350 - 2 * shared) // 2 + shared // 2 :]])
            cut = len(key[:shared]) + (350 - 2 * shared) // 2 + shared // 2
            owner = np.repeat([0, 1], [cut, len(both) - cut])
            marks = omh.sketches(both, owner, np.arange(len(both)), 3, omh.BANDS)[2]
            agree.append(int((marks[0] == marks[1]).sum()))
        assert (min(agree) >= least) if alike else (max(agree) < least)
