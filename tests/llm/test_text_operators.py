import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from documents_fixture import make  # noqa: F401
from pyspark.sql import functions as F

from scorewright.llm import kn_quality as KN
from scorewright.llm import latent_search as LS
from scorewright.llm import line_runs as LR
from scorewright.llm import mixing as MX
from scorewright.llm import string_kernel as SK
from scorewright.llm import substring_sa as SA
from scorewright.llm import text as T
from scorewright.llm import token_rollups as TR
from scorewright.llm import warc as W
from scorewright.llm.store import scratch


def test_words_of_pieces():
    texts = ["The  quick\tfox", None, "", "fox THE x", " a"]
    for most in (1, 1 << 20):
        seen = []
        for piece in T.pieces(pa.array(texts), most):
            w = T.words(piece)
            seen += [(piece.lo + r, bytes(piece.data[a:b]).decode(), h) for r, a, b, h in zip(w.row, w.start, w.end, w.hash, strict=True)]
        assert [(r, x) for r, x, _ in seen] == [(0, "The"), (0, "quick"), (0, "fox"), (3, "fox"), (3, "THE x"), (4, "a")]
        assert seen[2][2] == seen[3][2] and len({h for *_, h in seen}) == 5


def test_archives_round_trip(spark):
    big, small = "<p>" + "x y" * 500 + "</p>", "<p>tiny</p>"
    separator = W.SEPARATOR + "tail"
    rows = [(1, "u1", big), (2, None, big), (3, "u\r\n3", big), (4, "u", small), (5, "u", small), (6, "u", None), (None, "u", big), (7, "é", "ü" * 800 + separator), (8, "u", separator), (2, "again", big)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(2)
    path = scratch(spark, "warc-test")
    W.write_archives(pages, path, archive_bytes=4000)
    out = W.read_archives(spark, path).collect()
    want = []
    for ident, _, html in rows:
        body = (html or "").encode()
        copies = [i for i, _, h in rows if h == html and i is not None] if len(body) >= 1000 else []
        top = max(copies) if copies else ident
        revisit = bool(copies) and ident != top
        want.append((ident, "revisit" if revisit else "response", top if revisit else None, len(body), hashlib.sha1(body).hexdigest(), None if revisit else body))
    got = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, bytes(r.payload) if r.payload is not None else None) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)
    files = spark.read.format("binaryFile").load(path).select("content").collect()
    assert all(bytes(f.content[:4]) == b"\x5d\x2a\x4d\x18" for f in files)
    empty = scratch(spark, "warc-empty")
    W.write_archives(pages.limit(0), empty)
    assert W.read_archives(spark, empty).count() == 0


def test_archives_of_other_writers():
    payload = b"hello"
    record = W.record_bytes(1, "u", payload, hashlib.sha1(payload).hexdigest(), None, False)
    plain = zstandard.ZstdCompressor().compress(record)
    assert [W.parsed(r)[-1] for r in W.walk(plain + plain)] == [payload] * 2
    with pytest.raises(ValueError):
        list(W.walk(plain[:-3]))


def test_repeated_substrings_equal_brute_force(spark, make):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcd é") for _ in range(n))
    shared, other = word(90), word(60)
    texts = [None, "", word(300), shared, word(50) + shared + word(70), word(10) + shared[:70] + word(40), shared + shared, "ab" * 100, word(200) + other + word(3), other * 3]
    texts += [word(20) + shared + word(30) for _ in range(12)]
    rows = list(enumerate(texts)) + [(None, texts[2]), (3, texts[3]), (50, "\0" * 90), (51, "x" * 45)]
    length = 40
    data = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    want = []
    for (ident, _), d in zip(rows, data, strict=True):
        dead = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                dead[i : i + length] = True
        spans = sum(dead[i] and not (i and dead[i - 1]) for i in range(len(d)))
        want.append((ident, len(d), int(dead[: len(d)].sum()), int(spans), hashlib.sha256(bytes(b for b, x in zip(d, dead, strict=False) if not x)).hexdigest()))
    for hot in (4096, 2):  # also with every anchor hash split over shards
        out = SA.remove_repeats(make(rows), length, 12, hot_contexts=hot, shard_bytes=2000)
        assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert SA.remove_repeats(make([])).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = random.Random(5)
    for trial in range(30):
        a = bytes(rng.choice(b"ab\0") for _ in range(rng.randint(1, 200))) if trial % 3 else b"a" * (trial + 1)
        data = np.frombuffer(a, np.uint8)
        order = SA.suffix_array(data)
        assert order.tolist() == sorted(range(len(a)), key=lambda i: a[i:])
        common = [0]
        for x, y in zip(order, order[1:], strict=False):
            k = 0
            while max(x, y) + k < len(a) and a[x + k] == a[y + k]:
                k += 1
            common.append(k)
        assert SA.common_prefixes(data, order, lanes=5).tolist() == common


def test_line_runs(make):
    run = "first line\nsecond line\nthird line"
    rows = [(1, run + "\nown"), (2, "start\n" + run + "\n\nend"), (3, "second line\nthird line"), (4, None), (5, ""), (6, run), (7, "a\na\na\na\na"), (None, "zero\n" + run), (8, run.replace("\n", "\n \n"))]
    out = {r.row.doc_id: (r.row.text, r.n_lines, r.n_removed, r.n_runs) for r in LR.line_runs(make(rows)).collect()}
    assert out == {
        1: (run + "\nown", 4, 0, 0), 2: ("start\n\nend", 5, 3, 1), 3: ("second line\nthird line", 2, 0, 0), 4: (None, 0, 0, 0), 5: ("", 0, 0, 0),
        6: ("", 3, 3, 1), 7: ("a", 5, 4, 1), None: ("zero", 4, 3, 1), 8: (" \n ", 3, 3, 1),
    }
    kept = LR.drop_repeated_runs(make(rows))
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 5, 7, None} and kept.columns == make(rows).columns
    assert LR.drop_repeated_runs(make([])).count() == 0
    assert LR.line_runs(make(rows), min_lines=1).agg(F.sum("n_removed")).first()[0] == 3 + 2 + 3 + 4 + 3 + 3


def dead_lines(docs, min_lines, min_words):
    """Lines of every maximal run that starts earlier, by comparing all pairs of positions."""
    full = {i: [(at, x) for at, x in enumerate(t.split("\n")) if x.strip()] for i, t in docs.items()}
    starts = [(i, k) for i in sorted(full) for k in range(len(full[i]))]
    dead = collections.defaultdict(set)
    for n, (j, q) in enumerate(starts):
        for i, p in starts[:n]:
            a, b, size = full[i][p:], full[j][q:], 0
            while size < min(len(a), len(b)) and a[size][1] == b[size][1]:
                size += 1
            if size >= min_lines or sum(len(x.split()) for _, x in b[:size]) >= min_words:
                dead[j] |= {at for at, _ in b[:size]}
    return dead


@pytest.mark.parametrize("min_lines", [2, 3, 5])
def test_line_runs_by_lines_or_words(make, min_lines):
    rng = random.Random(min_lines)
    lines = ["a", "b c", "d e f", "g h i j", "k l m n o p q", "", " "]
    docs = {i: "\n".join(rng.choices(lines, [4, 4, 3, 2, 1, 1, 1], k=rng.randint(1, 9))) for i in range(40)}
    dead = dead_lines(docs, min_lines, 7)
    out = {r.row.doc_id: (r.row.text, r.n_removed) for r in LR.line_runs(make(list(docs.items())), min_lines, min_words=7).collect()}
    assert out == {i: ("\n".join(x for at, x in enumerate(t.split("\n")) if at not in dead[i]), len(dead[i])) for i, t in docs.items()}


def test_long_single_lines_go(make):
    long = " ".join(f"word{k}" for k in range(60))
    half = " ".join(f"part{k}" for k in range(25))
    rows = [(1, f"one\n{long}\ntwo"), (2, f"three\n{long}\nfour"), (3, f"{half}\n{half}x\nfive"), (4, f"six\n{half}\n{half}x"), (5, half)]
    out = {r.doc_id: r.text for r in LR.drop_repeated_runs(make(rows)).collect()}
    assert out == {1: rows[0][1], 2: "three\nfour", 3: rows[2][1], 4: "six", 5: half}


def test_fill_targets():
    assert MX.fill_targets([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    out = MX.fill_targets([10, 200, 0, 90], [3, 1, 5, 1])
    assert sum(out) == pytest.approx(300) and out[0] == 30 and out[2] == 0 and all(t <= 3 * n for t, n in zip(out, [10, 200, 0, 90], strict=True))


def test_permutation_visits_all():
    for n in (1, 2, 3, 17, 1000):
        out = MX.permuted(np.arange(n), np.full(n, n), np.full(n, 99, np.uint64))
        assert sorted(out) == list(range(n))


def test_mix(make):
    rng = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 400))), "en", rng.choice(["a", "b", "c", "d", None])) for i in range(120)] + [(0, None, "en", "e"), (1, "x", "en", "a"), (1, "x", "en", "a")]
    first = MX.mix_sources(make(rows), block_words=16, shard_slots=50).collect()
    again = MX.mix_sources(make(rows[::-1]), block_words=16, shard_slots=50).collect()
    assert sorted(map(tuple, first), key=str) == sorted(map(tuple, again), key=str) and len(first) == len(rows)
    taken = collections.Counter()
    for r in first:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    for r in first:
        assert abs(taken[r.source] - r.target) <= 24
    assert MX.mix_sources(make([])).count() == 0


def test_mix_is_packed(make):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(rng.randint(0, 90))), "en", rng.choice(["a", "b", None])) for i in range(60)] + [(7, "same words here", "en", "a")] * 2 + [(None, "n1 n2", "en", "a"), (None, "n3\tn4  n5", "en", "a"), (90, None, "en", "a")]
    docs = make(rows)
    mix = MX.mix_slots(docs, block_words=16, shard_slots=50)
    spans, of = mix.collect(), collections.defaultdict(list)
    for r in spans:
        of[r.shard, r.slot].append(r)
    for shard in {s for s, _ in of}:
        assert sorted(n for s, n in of if s == shard) == list(range(sum(s == shard for s, _ in of)))
    for parts in of.values():
        parts.sort(key=lambda r: r.at)
        assert len({(r.source, r.block) for r in parts}) == 1 and [r.at for r in parts] == [sum(r.words for r in parts[:k]) for k in range(len(parts))]
    first = [of[0, n][0].source for n in range(50) if (0, n) in of]
    assert sum(a != b for a, b in zip(first, first[1:], strict=False)) > len(set(first)) - 1

    words = {(r.shard, r.slot): r.text.split(" ") for r in MX.packed(mix, docs).collect()}
    assert {k: len(w) for k, w in words.items()} == {k: sum(r.words for r in parts) for k, parts in of.items()}
    text = {r.rk: r.text.split() for r in docs.withColumn("rk", MX.row_key("doc_id", "text")).where("text is not null").collect()}
    assert all(words[k][r.at : r.at + r.words] == text[r.rk][r.first_word : r.first_word + r.words] for k, parts in of.items() for r in parts)
    made = {(r.shard, r.slot): r for r in MX.mix_texts(docs, block_words=16, shard_slots=50).collect()}
    assert {k: r.text.split(" ") for k, r in made.items()} == words
    assert all([d for d in made[k].doc_ids] == [r.doc_id for r in parts] for k, parts in of.items())
    assert MX.mix_texts(docs.limit(0)).count() == 0
    taken, want = collections.Counter(), collections.Counter()
    for r in spans:
        taken[r.doc_id, r.source] += r.words
    for r in MX.mix_sources(docs, block_words=16, shard_slots=50).collect():
        want[r.doc_id, r.source] += r.taken
    assert +want == +taken


def test_quality_rejects_what_trusted_text_is_not(spark, make):
    rng = random.Random(7)
    say = lambda n: " ".join(rng.choice(["the", "and", "other", "nation", "reads", "rest"]) for _ in range(n))
    rows = [(i, say(60), "en") for i in range(80)] + [(100, "%$# @@ |~ " * 30, "en"), (101, say(60), None), (102, None, "en"), (103, "", "en")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100, 0, 0), (None, 1, 0), (7, None, 1)], "doc_id long, quality int, toxic int")
    out = {r.id: r for r in KN.judged(make(rows), labels).collect()}
    assert [i for i, r in out.items() if not r.kept] == [100] and out[102].perplexity is None
    assert sorted(KN.drop_rejected(make(rows), labels).columns) == sorted(make(rows).columns)
    assert KN.judged(make(rows), labels.limit(0)).where("not kept").count() == 0
    assert KN.judged(make([]), labels).count() == 0


def test_perplexity_is_the_same_for_any_head(spark, make, monkeypatch):
    rng = random.Random(17)
    say = lambda n: "".join(rng.choice("abcdefgh é\n9") for _ in range(n))
    rows = [(i, say(rng.randint(1, 300)), "en") for i in range(40)] + [(50, say(9000), "de"), (3, None, "en"), (4, "", None), (None, "abc", None)]
    rows += [(60, "abc é 9", "fr")] * 3
    labels = spark.createDataFrame([(i, 1, 0) for i in range(25)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(KN, "TAIL_ROWS", 100)  # tails go in several rows
    monkeypatch.setattr(KN, "FLUSH_GRAMS", 50)
    monkeypatch.setattr(KN, "MERGE_GRAMS", 40)
    scores = []
    for most in (0, 40, KN.HEAD_GRAMS):
        out = KN.perplexities(make(rows), labels, head_grams=most).collect()
        assert len(out) == len(rows)
        scores.append(sorted((r.id if r.id is not None else -1, r.th or 0, r.n_symbols, round(r.log_perplexity or 0, 5)) for r in out))
    assert scores[0] == scores[1] == scores[2]
    assert {r.n_symbols for r in out if r.id == 60} == {8} and len({r.log_perplexity for r in out if r.id == 60}) == 1


def test_threshold_is_the_quantile(spark):
    rows = [("en", True, k / 100) for k in range(1, 101)] + [("de", False, 9.0)]
    most = {r.lang: r.most for r in KN.thresholds(spark.createDataFrame(rows, "lang string, trusted boolean, log_perplexity double")).collect()}
    assert most == {"en": pytest.approx(0.99), "de": pytest.approx(0.99)}


def test_kneser_ney_probabilities_sum_to_one(spark, monkeypatch):
    for name, value in (("ORDER", 2), ("SYMBOLS", 64), ("BITS", 6)):
        monkeypatch.setattr(KN, name, value)
    counts = spark.createDataFrame([((a << 6) | b, c) for a, b, c in ((1, 2, 1), (1, 3, 2), (2, 3, 3), (3, 1, 4), (3, 2, 1))], "gram long, c long")
    seen = KN._seen_tables(counts)
    wanted = spark.createDataFrame([((a << 6) | b,) for a in (1, 3, 9) for b in range(64)], "gram long")
    p = collections.defaultdict(float)
    for r in KN._probabilities(wanted, seen, 2).collect():
        p[r.gram >> 6] += r.p
    assert all(v == pytest.approx(1.0) for v in p.values()) and len(p) == 3


def test_the_model_is_built_in_few_exchanges(spark, monkeypatch):
    """Every order is counted from the written one above it, and the discounts of all orders come from one query."""
    rng = random.Random(23)
    rows = {rng.randrange(4) << 32 | rng.randrange(4) << 24 | rng.randrange(4) << 16 | rng.randrange(4) << 8 | rng.randrange(4): rng.randrange(6) for _ in range(300)}
    counts = KN.written(spark.createDataFrame(list(rows.items()), "gram long, c long"), "test-grams")
    plans, real, singles = [], KN.written, []
    monkeypatch.setattr(KN, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    monkeypatch.setattr(type(counts), "first", lambda self: singles.append(self) or self.take(1)[0])
    seen = KN._seen_tables(counts)
    assert len(plans) == 5 and all(p.count("Exchange") <= 1 for p in plans)
    want = {g: c for g, c in rows.items() if c}
    for order in range(5, 0, -1):
        assert {r.gram: r.c for r in seen[order - 1].collect()} == want
        want = collections.Counter(g & KN._mask(order - 1) for g in want)
    for order, got in enumerate(KN._all_discounts(seen), 1):
        n = collections.Counter(r.c for r in seen[order - 1].collect())
        assert got == KN.discounts(n[1], n[2], n[3], n[4])
    p = KN._probabilities(counts.select("gram"), seen, KN.ORDER)
    assert not singles and all(0 < r.p < 1 for r in p.collect()) and p.count() == len(rows)


def test_latent_search_finds_paraphrases(spark, make):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [say(n) for n in (18, 30, 50, 120)]
    docs = [(i, " ".join(say(rng.randint(5, 200)))) for i in range(150)] + [(999, None), (998, "")]
    for k, words in enumerate(items):
        changed = [w if rng.random() > 0.12 else rng.choice(vocabulary) for w in words]
        docs += [(1000 + k, " ".join(say(40) + words + say(33)).upper()), (2000 + k, ", ".join(say(21) + changed + say(50)))]
    benchmark = spark.createDataFrame([(i, " ".join(w), 1) for i, w in enumerate(items)] + [(77, None, 1), (78, "a b", 1)], "item_id long, text string, item int")
    got = {(r.doc_id, r.item_id) for r in LS.leaks(make(docs), benchmark).collect()}
    assert got == {(base + k, k) for base in (1000, 2000) for k in range(len(items))}
    assert LS.drop_leaks(make(docs), benchmark).count() == 152
    assert LS.leaks(make([]), benchmark).count() == 0 and LS.leaks(make(docs), benchmark.limit(0)).count() == 0


def test_any_window_that_passes_counts(spark, make):
    """A document with the last half of an item, and further on a greater part of it without its end."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    item, fill = [word() for _ in range(20)], lambda n: [word() for _ in range(n)]
    docs = [(1, " ".join([*fill(30), *item[10:], *fill(60), *item[:11], *fill(30)])), (2, " ".join([*fill(30), *item[10:], *fill(60)])), (3, " ".join([*fill(30), *item[:11], *fill(60)]))]
    docs += [(10 + k, " ".join(fill(60))) for k in range(60)]
    benchmark = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    assert {r.doc_id for r in LS.leaks(make(docs), benchmark).collect()} == {1, 2}
    assert not LS.passes(0.55, 0.0) and LS.passes(0.5, 1.0)


def test_recall_of_the_gates_beyond_the_fit_sample(spark, make, monkeypatch):
    """Of all documents that hold an item by brute force over every window, the gates lose none or few."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [say(rng.randint(15, 60)) for _ in range(12)]
    docs = []
    for i in range(400):
        words = say(rng.randint(20, 120))
        if i % 4 == 0:
            kept = [w if rng.random() > 0.25 else rng.choice(vocabulary) for w in items[i // 4 % 12]]
            words[10:10] = kept
        docs.append((i, " ".join(words)))
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    monkeypatch.setattr(LS, "FIT_DOCS", 100)
    got = {(r.doc_id, r.item_id) for r in LS.leaks(make(docs), benchmark).collect()}
    monkeypatch.setattr(LS, "LEAST_COSINE", -2.0)
    monkeypatch.setattr(LS, "LEAST_RARE", 0)
    sample = [t for _, t in docs[:100]]
    fold = np.zeros((LS.TERMS + 1, 1), np.float32)
    q = LS.queries([(i, " ".join(w)) for i, w in enumerate(items)], fold[:-1], np.ones(LS.TERMS))
    want = set()
    for piece in T.pieces(pa.array([t for _, t in docs])):
        for r, s, _, common, answer in LS.found_in(T.words(piece, T.NOT_LETTERS), fold, q):
            if LS.passes(common, answer):
                want.add((docs[piece.lo + r][0], q.item[s]))
    assert sample and len(want) >= 80 and got <= want and len(got) >= 0.95 * len(want)


def test_columns_with_dots_pass(spark, make):
    docs = make([(1, "a b c d e f\nx y\nz"), (2, "a b c d e f\nx y\nz"), (3, None)]).withColumn("a.b", F.lit(1))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    from scorewright.llm.parity_join import drop_near_duplicates

    for kept in (KN.drop_rejected(docs, labels), LR.drop_repeated_runs(docs), drop_near_duplicates(docs), LS.drop_leaks(docs, benchmark)):
        assert kept.columns == docs.columns and kept.count() >= 1


def test_dictionaries_come_from_long_pages_too(spark, caplog):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    pages = spark.createDataFrame([(i, "u", " ".join(rng.choice(words) for _ in range(9000))) for i in range(40)], "page_id long, url string, html string")
    path = scratch(spark, "warc-long")
    W.write_archives(pages, path)
    heads = [bytes(f.content[:8]) for f in spark.read.format("binaryFile").load(path).select("content").collect()]
    assert all(int.from_bytes(h[4:], "little") > 1000 for h in heads)
    with caplog.at_level("WARNING"):
        W.write_archives(pages.limit(1).select("page_id", "url", F.lit("x").alias("html")), scratch(spark, "warc-short"))
    assert "without a dictionary" in caplog.text


def test_payloads_are_shuffled_once(spark, monkeypatch):
    plans = []
    kind = type(spark.range(1))
    own = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **k: plans.append(self._jdf.queryExecution().executedPlan().toString()) or own(self, *a, **k))
    W.write_archives(spark.createDataFrame([(i, "u", "x" * 1500) for i in range(50)], "page_id long, url string, html string"), scratch(spark, "warc-plan"), archive_bytes=3000)
    initial = plans[0].split("Initial Plan")[-1]
    assert sum("Exchange" in line and "html" in line for line in initial.splitlines()) <= 1
    assert initial.count("REPARTITION_BY_NUM") == 1


def test_toxic_text_with_gaps(spark, make):
    rng = random.Random(9)
    say = lambda n: [rng.choice(["the", "and", "other", "nation", "reads", "rest", "loss", "closer"]) for _ in range(n)]
    insults = ["idiot", "loser", "worthless"]
    rows, labels = [], []
    for i in range(200):
        words = say(30)
        if i % 4 == 0:
            words[5] = rng.choice(insults)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(1001, " ".join([*say(8), "i d i o t", *say(8)])), (1002, " ".join([*say(8), "lo*ser", "idiiot", *say(8)])), (1003, " ".join(say(20))), (1004, None), (1005, ""), (None, "x")]
    labels += [(None, 1, 1), (1003, 1, None)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in SK.toxicity(make(rows), table).collect()}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out.values())
    assert sum(out[i].predicted != int(i % 4 == 0) for i in range(200) if out[i].held_out) == 0
    assert [out[i].predicted for i in (1001, 1002, 1003, 1004, 1005)] == [1, 1, 0, 0, 0]
    assert all(r.score == 0 for r in SK.toxicity(make(rows), table.limit(0)).collect())
    assert SK.toxicity(make([]), table).count() == 0


def test_rollups_count_each_batch_once(spark):
    schema = "op string, old_source string, old_lang string, old_tokenizer string, old_tokens long, source string, lang string, tokenizer string, tokens long"
    rollups = TR.Rollups(spark, scratch(spark, "rollups-test"))
    assert rollups.totals().count() == 0
    load = spark.createDataFrame([("insert", None, None, None, None, "a", "en", "v1", 10), ("insert", None, None, None, None, "a", "en", "v1", 5), ("insert", None, None, None, None, None, "en", "v1", None)], schema)
    change = spark.createDataFrame([("revise", "a", "en", "v1", 10, "a", "en", "v2", 12), ("delete", "a", "en", "v1", 5, None, None, None, None)], schema)
    assert rollups.apply("one", load) and not rollups.apply("one", load)
    assert rollups.apply("two", change) and not TR.Rollups(spark, rollups.path).apply("two", change)
    assert rollups.apply("three", load.limit(0))
    assert {tuple(r) for r in rollups.totals().collect()} == {("a", "en", "v1", 0, 0), ("a", "en", "v2", 1, 12), (None, "en", "v1", 1, 0)}
    with pytest.raises(Exception, match="unknown operation"):
        rollups.apply("four", load.withColumn("op", F.lit("upsert")))
    with pytest.raises(ValueError, match="id"):
        rollups.apply("", load)
    assert rollups.totals().count() == 3


def test_token_counts(make):
    out = {r.doc_id: r._tokens for r in TR.token_counts(make([(1, "Hello world"), (2, None), (3, "")]).select("doc_id", "text")).collect()}
    assert out == {1: 2, 2: 0, 3: 0}


def test_latent_space_is_fitted_on_all_documents(spark, make, monkeypatch):
    """The fit sees every text, also beyond FIT_DOCS of them, and gives the singular vectors of the whole matrix."""
    monkeypatch.setattr(LS, "FIT_DOCS", 20)
    rng = random.Random(4)
    groups = [["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(15)] for _ in range(10)]
    texts = [" ".join(rng.choice(groups[i % 10]) for _ in range(40 + 3 * (i % 10))) for i in range(200)]
    fitted, real = [], LS.latent_terms
    monkeypatch.setattr(LS, "latent_terms", lambda texts, idf: fitted.extend(r.text for r in texts.collect()) or real(texts, idf))
    benchmark = spark.createDataFrame([(1, texts[3])], "item_id long, text string")
    found = LS.leaks(make(list(enumerate(texts))), benchmark).collect()
    assert sorted(fitted) == sorted([*texts, texts[3]]) and {r.doc_id for r in found} >= {3}

    _, idf = LS.inverse_frequencies(make(list(enumerate(texts))).select("text"))
    fold = real(make(list(enumerate(texts))).select("text"), idf)
    dense = []
    for piece in T.pieces(pa.array(texts)):
        a = LS.passages(T.words(piece, T.NOT_LETTERS), idf)
        rows = np.zeros((a.rows, LS.TERMS), np.float32)
        rows[a.row, a.term] = a.weight
        dense.append(rows)
    gram = np.concatenate(dense)
    gram = (gram @ gram.T).astype(np.float64)
    value = np.linalg.eigvalsh(gram)[::-1][:8]
    used = idf > 0
    space = fold[used, :8] / idf[used, None]
    got = 1 / np.linalg.norm(space.astype(np.float64), axis=0) ** 2
    assert np.all(np.abs(got / value - 1) < 0.1)


def test_a_hot_shard_sends_repeated_windows_once():
    """Near copies of one passage: their common windows leave the shard once, not once per copy."""
    rng = random.Random(6)
    common = bytes(rng.randrange(97, 123) for _ in range(60))
    contexts = [common + bytes([65 + i]) + bytes(rng.randrange(97, 123) for _ in range(19)) for i in range(30)]
    n = len(contexts)
    table = pa.table({"s1": [5] * n, "split": [2] * n, "rk": list(range(n)), "first": [0] * n, "copies": [1] * n, "bytes": contexts})
    out = SA._shard(20)(table)
    rows = np.concatenate([np.frombuffer(x.as_py(), SA._ROW) for x in out.column("windows") if x.is_valid])
    assert rows["done"].sum() == 41 and (~rows["done"]).sum() == n * 20
    spans = {(r["rk"], r["lo"], r["hi"]) for r in out.to_pylist() if r["rk"] is not None}
    assert spans == {(i, 0, 60) for i in range(n)}


def test_products_of_the_fit_by_blocks(monkeypatch):
    monkeypatch.setattr(LS, "BLOCK_PASSAGES", 3)
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij", "kl"], n)) for n in (0, 5, 200, 33, 1)]
    piece = next(T.pieces(pa.array(texts)))
    a = LS.passages(T.words(piece, T.NOT_LETTERS), rng.random(LS.TERMS), 8)
    q, out = rng.standard_normal((LS.TERMS, 4), np.float32), np.ones((LS.TERMS, 4))
    LS.add_products(a, q, out)
    dense = np.zeros((a.rows, LS.TERMS))
    dense[a.row, a.term] = a.weight
    assert a.rows == 32 and np.allclose(out, 1 + dense.T @ (dense @ q), atol=1e-4)
    LS.add_products(LS.Passages(a.row[:0], a.term[:0], a.weight[:0], 0), q, out)


@pytest.mark.parametrize("least", (1, 2, 3))
def test_only_windows_with_rare_words_are_compared(monkeypatch, least):
    """The pairs of the rare words' places are those of all windows and segments, each once."""
    monkeypatch.setattr(LS, "LEAST_RARE", least)
    monkeypatch.setattr(LS, "PAIRS_AT_ONCE", 7)
    rng = np.random.default_rng(least)
    from_, to = np.sort(rng.integers(0, 300, 40)), np.sort(rng.integers(5, 330, 40))
    hits = np.unique(rng.integers(0, 6 * 400, 90))
    segment, place = hits // 400, hits % 400
    want = {(w, s) for w in range(40) for s in range(6) if ((segment == s) & (place >= from_[w]) & (place < to[w])).sum() >= least}
    got = [(int(w), int(s)) for ws, ss in LS._rare_pairs(segment, place, from_, to) for w, s in zip(ws, ss, strict=True)]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert not list(LS._rare_pairs(segment[:0], place[:0], from_, to))


def test_probabilities_of_an_order_are_a_short_plan(spark, monkeypatch):
    """Each order reads the one below from the shared folder, so the plan of the highest does not hold them all."""
    counts = spark.createDataFrame([(65 << 8 | 66, 2, 2), (66 << 8 | 65, 1, 1), (65 << 8 | 65, 1, 1)], "gram long, c long, f long")
    monkeypatch.setattr(KN, "ORDER", 3)
    seen = KN._seen_tables(counts.select("gram", "c"))
    plan = KN._probabilities(counts.select("gram"), seen, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") <= 3


def test_windows_without_rare_words_are_searched():
    """A document that holds most of an item, but none of its rarest words, is found: the cosine of each window counts."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    common, rare = [word() for _ in range(30)], [word() for _ in range(LS.RARE)]
    item = [w for pair in zip(common[:8], rare, strict=True) for w in pair] + common[8:]
    texts = [" ".join([*(word() for _ in range(30)), *common, *(word() for _ in range(50))]), " ".join(word() for _ in range(80))]
    idf = np.ones(LS.TERMS)
    idf[LS._terms(T.words(next(T.pieces(pa.array([" ".join(rare)]))), T.NOT_LETTERS).hash)] = 2.0
    fold = np.random.default_rng(4).standard_normal((LS.TERMS, LS.DIMS)).astype(np.float32)
    q = LS.queries([(1, " ".join(item))], fold, idf)
    piece = next(T.pieces(pa.array(texts)))
    found = list(LS.found_in(T.words(piece, T.NOT_LETTERS), np.vstack([fold, np.zeros((1, LS.DIMS), np.float32)]), q))
    assert [(r, s) for r, s, *_, common, answer in found if LS.passes(common, answer)] == [(0, 0)]


@pytest.mark.parametrize("dense", (1 << 20, 0))
def test_each_candidate_is_checked_and_the_best_window_is_told(monkeypatch, dense):
    """Shares of all windows against the plain subsequence, also behind a window that is sure."""
    monkeypatch.setattr(LS, "DENSE", dense, raising=False)
    monkeypatch.setattr(LS, "LEAST_COSINE", -2.0)
    monkeypatch.setattr(LS, "PLACES_AT_ONCE", 500, raising=False)
    monkeypatch.setattr(LS, "PRODUCT_SIDE", 8, raising=False)
    rng = random.Random(5)
    vocabulary = [f"w{i}".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(40)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [say(n) for n in (5, 9, 16, 24, 33, 64, 64)]
    texts = [say(n) for n in (0, 3, 5, 40, 130, 300)]
    texts[4][100:100] = items[3]
    texts[4][20:20] = items[3][:15]  # sure, and before the whole item
    fold = np.zeros((LS.TERMS + 1, 1), np.float32)
    q = LS.queries([(i, " ".join(w)) for i, w in enumerate(items)], fold[:-1], np.ones(LS.TERMS))
    w = T.words(next(T.pieces(pa.array([" ".join(t) for t in texts]))), T.NOT_LETTERS)
    got = {(r, s): (common, answer) for r, s, _, common, answer in LS.found_in(w, fold, q)}
    want = {}
    for r, text in enumerate(texts):
        h = w.hash[w.first[r] : w.first[r + 1]].tolist()
        for s, words in enumerate(q.words):
            words, size = words.tolist(), int(q.blocks[s])
            blocks, stride = -(-len(text) // LS.STEP), 1 if size <= 6 else 2
            for i in range(0, blocks, stride):
                if i == 0 or i + size < blocks + stride:
                    spare = LS.STEP * size // 2
                    seen = h[max(0, LS.STEP * i - spare) : LS.STEP * (i + size) + spare]
                    tail = words[-LS.ANSWER_WORDS :]
                    facts = tuple(LS.common_subsequence(seen, LS.masks_of(x), len(x)) / len(x) for x in (words, tail))
                    old = want.get((r, s), (-1.0, 0.0))
                    if (LS.passes(*facts), facts[0]) > (LS.passes(*old), old[0]):
                        want[r, s] = facts
    assert got == {k: v for k, v in want.items() if v[0] >= LS.LCS_WITH_ANSWER} and got[4, 3][0] == 1.0
