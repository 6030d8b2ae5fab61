"""The registered queries themselves, on null and repeated ids, repeated rows, empty and long texts, clashing columns."""

from collections import Counter, defaultdict
import hashlib
from itertools import permutations
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F
import pytest
from tokenizers import Tokenizer

from loreloom.llm import filter_audit, minhash, ngram_join
from loreloom.llm.queries import QUERIES, vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def words_of(t):
    return WORD.findall(t or "")


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, source): ids are null, repeated with other texts, and repeated with the same."""
    random.seed(21)
    some = ["the", "Abc", "zig", "é", "漢字", "x1", "don't", "...", "of", "queen", "stone", "#river", "a|b", "<i>"]
    line = lambda n: " ".join(random.choices(some, k=n))
    base = [line(random.randint(30, 90)) for _ in range(10)]
    near = [" ".join(w if i != 15 else "changed" for i, w in enumerate(b.split(" "))) for b in base[:4]]
    long = "\n".join(line(9) for _ in range(3000))
    texts = [*base, *near, base[0], base[1].replace(" ", "\t"), None, "", " \n ", "one", "a" * 1500, "<|endoftext|> x", "same\nline\nsame\nline", long]
    out = [(100 + i, t, None if i % 5 == 0 else "" if i % 5 == 1 else f"s{i % 3}") for i, t in enumerate(texts)]
    out += [(None, base[2], "s0"), (None, base[2], "s0"), (None, line(40), None), (None, None, "s1")]  # null ids, one row twice
    out += [(101, base[3] + " and more", "s0"), (101, line(50), "s0"), (103, out[3][1], out[3][2])]  # repeated ids, and a repeated row
    return out


def some_vectors():
    """(vec_id, embedding, label): null, empty, odd, broken, repeated and far-out vectors, null and repeated ids."""
    random.seed(12)
    own = lambda width=32: [float(np.float32(random.gauss(0, 0.3))) for _ in range(width)]
    out = [(500 - i, own(), random.choice([None, 1, 2, 3])) for i in range(150)]
    hot = own()
    out += [(1000 + i, hot, 7) for i in range(60)] + [(None, own(), None), (None, own(), 1), (3, out[5][1], 2), (3, out[5][1], 2), (3, own(), 2)]
    out += [(1, None, 1), (2, [], 1), (4, own(16), 1), (5, own(33), 1), (6, [*own(31), None], 1), (7, [*own(31), float("nan")], 1), (8, [*own(31), float("-inf")], 2), (9, [3000.5] * 32, 2)]
    return out


VECTORS = some_vectors()


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("odd"))
    clash = [(*r, "clash", i, "c", 1.5, None) for i, r in enumerate(rows)]
    schema = "doc_id long, text string, source string, id string, size int, row string, key double, place string"
    spark.createDataFrame(clash, schema).repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(101, 1, 0), (103, 0, 1), (None, 1, 1), (107, None, None)], "doc_id long, toxic int, quality int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(*v, "clash", i, "x") for i, v in enumerate(VECTORS)], "vec_id long, embedding array<float>, label int, block string, pos int, error string").repartition(3).write.parquet(f"{top}/embeddings.parquet")
    return top


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{top}/embeddings.parquet")
    return top


def run(spark, n, folder, *columns):
    """Rows of query n, as many times as they come."""
    name = next(k for k in QUERIES if k.startswith(f"op{n}_"))
    return Counter(map(tuple, QUERIES[name](spark, folder).select(*columns).collect()))


@pytest.mark.parametrize("name", QUERIES)
def test_empty_table(spark, nothing, name):
    assert QUERIES[name](spark, nothing).count() == 0


def test_op1(spark, folder, rows):
    tokenizer = Tokenizer.from_file(vocabulary_path())
    n = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t, _ in rows]
    want = Counter((i, len((t or "").encode()), k, k > 512) for (i, t, _), k in zip(rows, n))
    assert run(spark, 1, folder, "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_op2(spark, folder, rows):
    assert sum(run(spark, 2, folder, "doc_id", "text").values()) == len(rows)


def shingle_set(text, k=5):
    own = [w.encode().lower() for w in words_of(text)]
    return {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if len(own) >= k else ({tuple(own)} if own else set())


def plain_components(texts, k=5, percent=75):
    """Sets and, for each text, the place of the first text of its component."""
    sets, parent, having = [shingle_set(t, k) for t in texts], [*range(len(texts))], defaultdict(list)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, own in enumerate(sets):
        common = Counter(j for x in own for j in having[x])
        for j, n in common.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
        for x in own:
            having[x].append(i)
    return sets, [top(i) for i in range(len(texts))]


def test_op3(spark, folder, rows):
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sets, tops = plain_components([t for _, t, _ in ordered])
    want = Counter((r[0], len(s), ordered[t][0], ordered[t][0] == r[0]) for r, s, t in zip(ordered, sets, tops))
    assert run(spark, 3, folder, "doc_id", "n_shingles", "component_id", "kept") == want


def test_op3_on_the_given_table(spark):
    rows = sorted(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    sets, tops = plain_components([t for _, t in rows])
    want = Counter((r[0], len(s), rows[t][0], rows[t][0] == r[0]) for r, s, t in zip(rows, sets, tops))
    assert run(spark, 3, SF, "doc_id", "n_shingles", "component_id", "kept") == want


def test_op3_in_large_groups(spark):
    """Copies of one text, each changed in places of its own, so that many are linked with few others or none."""
    random.seed(6)
    texts = []
    for base in (240, 300):
        words = [f"w{base}x{i}" for i in range(base)]
        for i in range(260):
            own = list(words)
            for at in random.sample(range(base), random.randint(2, 8)):
                own[at] = f"v{i}x{at}" if random.random() < 0.7 else f"v{at}"
            texts.append(" ".join(own))
    sets, tops = plain_components(texts)
    assert 10 < len(set(tops)) < 500
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == tops


def test_op4(spark, folder, rows):
    got = run(spark, 4, folder, "doc_id", "held_out")
    assert got == Counter((i, zlib.crc32(str("" if i is None else i).encode()) % 5 == 0) for i, _, _ in rows)
    scores = QUERIES["op4_kneser_ney_toxicity"](spark, folder).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scores)


def test_op5(spark, folder, rows):
    tokenizer = Tokenizer.from_file(vocabulary_path())
    want = Counter()
    for i, t, _ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))] += 1
    assert run(spark, 5, folder, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_op6(spark, folder, rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _ in rows]
    ids, size = defaultdict(list), Counter(norm)
    for (i, _, _), t in zip(rows, norm):
        ids[t].append(i)
    keep = {t: min((i for i in own if i is not None), default=None) for t, own in ids.items()}
    want = Counter((i, keep[t], size[t], keep[t] == i, sha(t)) for (i, _, _), t in zip(rows, norm))
    assert run(spark, 6, folder, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want


def plain_quality(rows, line_docs=20):
    """The contract's counts and the verdict of each row."""
    contents, out = defaultdict(set), []
    fold = lambda line: tuple(re.sub(r"[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), w)) for w in words_of(line))
    for _, t, host in rows:
        for line in (t or "").split("\n"):
            if words_of(line):
                contents[host, fold(line)].add(tuple(words_of(t)))
    for i, t, host in rows:
        own = words_of(t)
        windows = Counter(tuple(own[j : j + 5]) for j in range(len(own) - 4))
        cover = {k for j in range(len(own) - 4) if windows[tuple(own[j : j + 5])] > 1 for k in range(j, j + 5)}
        lines = [x for x in (t or "").split("\n") if words_of(x)]
        kept = sum(len(words_of(x)) for x in lines if len(contents[host, fold(x)]) <= line_docs)
        failed = len(own) < 10 or 100 * len(cover) > 20 * len(own)
        out.append((i, len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover), failed, not failed and kept >= 10 and 2 * kept >= len(own)))
    return out


COUNTS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def test_op7(spark, folder, rows):
    assert run(spark, 7, folder, *COUNTS) == Counter(plain_quality(rows))


def test_op7_rejects(spark, tmp_path):
    """Lines of just as many documents as the limit and of one more, in hosts that are null, empty or large."""
    random.seed(3)
    rows = []
    for host, n in ((None, 21), ("", 20), ("h", 60), ("g", 25)):
        for i in range(n):
            own = " ".join(random.choice("bcdfgh") + random.choice("aeiou") + random.choice("kmn") for _ in range(random.randint(4, 14)))
            shared = f"Printed on 2{i % 10} May from the pages of this host & its friends" if i < 21 or host == "g" else f"page {own} of its own with some more words here"
            rows.append((len(rows), f"{shared}\n{own}\n# {own} again", host))
    rows += [(900, rows[0][1], None), (901, rows[30][1], "")]  # exact copies count once
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    want = plain_quality(rows)
    assert {r[-1] for r in want if not r[-2]} == {True, False}
    assert run(spark, 7, str(tmp_path), *COUNTS) == Counter(want)


def test_op8(spark, folder, rows):
    got = run(spark, 8, folder, "doc_id", "size", "source_size", "target", "taken")
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words_of(t))
    assert Counter((k[0], k[1], k[2]) for k in got.elements()) == Counter((i, len(words_of(t)), sizes[s]) for i, t, s in rows)
    assert all(taken <= 2 * size for _, size, _, _, taken in got)
    target = {size: t for _, _, size, t, _ in got}
    taken = Counter()
    for _, _, size, _, n in got.elements():
        taken[size] += n
    assert len(target) == len(sizes) and all(abs(taken[k] - target[k]) <= 3 * 128 for k in target)
    assert got == run(spark, 8, folder, "doc_id", "size", "source_size", "target", "taken")


def test_op9(spark, folder, rows):
    raw = [(t or "").encode() for _, t, _ in rows]
    counts = Counter(b[j : j + 200] for b in raw for j in range(len(b) - 199))
    want = Counter()
    for (i, _, _), b in zip(rows, raw):
        cover = np.zeros(len(b) + 1, int)
        for j in range(len(b) - 199):
            if counts[b[j : j + 200]] > 1:
                cover[j] += 1
                cover[j + 200] -= 1
        cover = np.cumsum(cover)[:-1] > 0
        want[i, len(b), int(cover.sum()), int((np.diff(np.append(False, cover).astype(int)) == 1).sum()), sha(np.frombuffer(b, np.uint8)[~cover].tobytes())] += 1
    assert sum(n for (_, _, removed, _, _), n in want.items() if removed)
    assert run(spark, 9, folder, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_op10(spark, folder, rows):
    got = run(spark, 10, folder, "doc_id", "size", "text_crc32", "law", "grown_shard")
    assert got == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "bytes", None) for i, t, _ in rows)
    slots = defaultdict(list)
    for shard, slot in run(spark, 10, folder, "shard", "slot").elements():
        slots[shard].append(slot)
    assert set(slots) <= set(range(16)) and all(sorted(v) == [*range(len(v))] for v in slots.values())


def test_op10_on_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    placed = QUERIES["op10_histogram_sort"](spark, sf)
    held = [r.n for r in placed.groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(held) == 16 and max(held) - min(held) < 0.1 * sum(held) / 16
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    apart = placed.join(texts, "doc_id").groupBy("text").agg(F.countDistinct("shard").alias("n"), F.sum("size").alias("size"))
    assert not apart.filter((F.col("n") > 1) & (F.col("size") <= sum(held) / 16 / 16 / 2)).count()


def test_op11(spark, folder, rows):
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sets, tops = plain_components([t for _, t, _ in ordered], 3, 90)
    want = Counter((r[0], len(s), ordered[t][0]) for r, s, t in zip(ordered, sets, tops))
    assert run(spark, 11, folder, "doc_id", "n_shingles", "component_id") == want


def test_op11_on_the_given_table(spark):
    rows = sorted(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    sets, tops = plain_components([t for _, t in rows], 3, 90)
    want = Counter((r[0], len(s), rows[t][0]) for r, s, t in zip(rows, sets, tops))
    assert run(spark, 11, SF, "doc_id", "n_shingles", "component_id") == want


def test_op11_in_large_groups(spark):
    """Chains of copies about as similar as the limit, among short texts of few words and one passage that all share."""
    random.seed(8)
    texts, passage = [], " ".join(f"p{i}" for i in range(40))
    for base, changes in ((60, 2), (150, 3), (400, 8)):
        words = [f"w{base}x{i}" for i in range(base)]
        for i in range(120):
            own = list(words) if i % 3 or not i else texts[-1].split(" ")
            for at in random.sample(range(base), random.randint(0, changes)):
                own[at] = f"v{i}x{at}" if random.random() < 0.6 else f"v{at}"
            texts.append(" ".join(own))
    texts += [f"{passage} " + " ".join(random.choices("abcdefgh", k=random.randint(3, 9))) for _ in range(80)]
    texts += [" ".join(random.choices("xyz", k=random.randint(1, 14))) for _ in range(150)]
    sets, tops = plain_components(texts, 3, 90)
    assert 50 < len(set(tops)) < len(set(texts)) - 50
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in ngram_join.linked(df).collect()}
    assert [got[i] for i in range(len(texts))] == tops


@pytest.mark.parametrize("percent", [60, 75, 90, 97])
def test_similar_sets_share_a_signature(percent):
    """All pairs above the limit, of sizes in one level or two and with as few n-grams in common as they may have."""
    rng, levels = np.random.default_rng(percent), ngram_join.Levels(percent)
    for n in (1, 5, 9, 13, 14, 40, 41, 200, 1000):
        for m in {n, n + 1, n * 100 // percent}:
            both = -(-percent * (n + m) // (100 + percent))
            if not both <= n <= m or (n == m == both):
                continue
            for _ in range(20):
                grams = rng.integers(0, 1 << 64, n + m - both, dtype=np.uint64)
                left, right = np.sort(grams[:n]), np.sort(grams[n - both :])
                own, sign = ngram_join.signatures(levels, np.array([n, m]), np.repeat([0, 1], [n, m]), np.concatenate([left, right]))
                assert set(sign[own == 0].tolist()) & set(sign[own == 1].tolist()), (n, m)


def plain_codes(vectors, parts=16, entries=64, rounds=2):
    """The contract on integers of any size, row by row."""
    kept = [(i, v, label) for i, v, label in vectors if v and len(v) == 32 and all(x is not None and np.isfinite(x) for x in v)]
    kept = sorted(((i, [int(np.floor(256 * x)) for x in v], label, v) for i, v, label in kept), key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    w = len(kept[0][1]) // parts
    cut = [[tuple(q[p * w : p * w + w]) for p in range(parts)] for _, q, _, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            of = defaultdict(list)
            for c, f in zip(cut, found):
                of[f[p][1]].append(c[p])
            for k, own in of.items():
                books[p][k] = tuple(sum(x) // len(own) for x in zip(*own))
    found, by_label = assign(), Counter()
    for (_, _, label, _), f in zip(kept, found):
        by_label[label] += sum(d for d, _ in f)
    digest = sha(",".join(str(x) for book in books for e in book for x in e))
    return Counter((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), by_label[label], digest) for (i, _, label, _), f in zip(kept, found))


def test_op12(spark, folder):
    want = plain_codes(VECTORS)
    assert sum(want.values()) == 216
    assert run(spark, 12, folder, "vec_id", "code", "error", "label_error", "codebooks_sha256") == want


def plain_audit(rows, labels):
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    fails = []
    for i, t, part in rows:
        own, x = words_of(t), t or ""
        least = smallest.get(x)
        found = (len(own) < 200, 100 * len(set(own)) < 50 * len(own), 100 * len(re.findall("[A-Z]", x)) > 2 * len(x), bool(re.search("[#$%&*|]", x)), least is not None and (i is None or i > least))
        fails.append((part or "", {k for k, f in zip("ABCDE", found) if f}, *(any(j == i and v[at] == 1 for j, *v in labels if i is not None) for at in (0, 1))))
    out, shapley = {}, Counter()
    for part in {f[0] for f in fails}:
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                gone, row = set(order[: step - 1]), [0] * 6
                for of, failed, good, bad in fails:
                    if of == part:
                        removed = letter in failed and not failed & gone
                        row = [a + b for a, b in zip(row, (not failed & (gone | {letter}), removed, letter in failed and bool(failed & gone), failed == {letter}, removed and good, removed and bad))]
                out[part, "".join(order), step] = row
                shapley[part, letter] += row[1]
    return Counter((*k, *row, shapley[k[0], k[1][k[2] - 1]]) for k, row in out.items())


def test_op13(spark, folder, rows):
    want = plain_audit(rows, [(101, 0, 1), (103, 1, 0), (None, 1, 1), (107, None, None)])
    names = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert run(spark, 13, folder, *names) == want


def test_cells_of_texts(spark, monkeypatch):
    """Prefixes are split until their texts are few, and a text of many copies ends as a cell of its own."""
    random.seed(13)
    texts = ["same start of all " * 6 + random.choice(["", "a", "b" * 90]) + str(random.randint(0, 40)) for _ in range(300)] + ["hot " * 60] * 90
    df = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "id long, text string, part string").repartition(5)
    dealt = filter_audit.cells(df, cell_bytes=2000).cache()
    assert all(r.text.startswith(r.cell) for r in dealt.collect())
    assert dealt.groupBy("cell").agg(F.sum(F.length("text")).alias("n"), F.countDistinct("text").alias("texts")).filter("n > 4000 AND texts > 1").count() == 0
    monkeypatch.setattr(filter_audit, "HELD", 3000)
    got = {r.id for r in filter_audit.masks(df.withColumnsRenamed({"id": "doc_id", "part": "source"})).filter("mask & 16 > 0").collect()}
    assert got == {i for i, t in enumerate(texts) if t in texts[:i]}


def test_trie():
    random.seed(5)
    trie, seen, back = filter_audit.Trie(), {}, Counter()
    for _ in range(3000):
        text, own = bytes(random.choices(b"ab", k=random.randint(0, 9))), random.randint(0, 50)
        back.update(trie.insert(text, (False, own), (own, "p", 0), 1))
        seen.setdefault(text, Counter())[own] += 1
    found = dict(trie.terminals())
    assert list(found) == sorted(seen)
    assert all(found[t] == {(min(own), "p", 0): own[min(own)]} for t, own in seen.items())
    assert sum(back.values()) == sum(n for own in seen.values() for i, n in own.items() if i > min(own))
