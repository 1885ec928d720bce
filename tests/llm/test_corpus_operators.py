"""Operators over the whole corpus, against brute force on small fixtures."""

import random
import time
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallymark.llm import line_dedup, linkage, ngram_join, warc
from tallymark.llm.common import Scratch
from tallymark.llm.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


def components(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return [root(x) for x in range(n)]


def test_connected_components(spark):
    r = random.Random(4)
    links = [(r.randrange(40), r.randrange(40)) for _ in range(25)] + [(k, k + 1) for k in range(40, 59)]
    got = {x.node: x.component for x in linkage.connected_components(Scratch(spark, "t"), spark.createDataFrame(links, "a long, b long")).collect()}
    want = components(60, links)
    assert all(got[v] == want[v] for v in got) and set(got) == {v for a, b in links if a != b for v in (a, b)}


def corpus(seed, size):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    texts = [None, "", "  \n", "one", "ONE", "one two", "x y z", "é x y"]
    while len(texts) < size:
        base = [word() for _ in range(r.choice([5, 9, 14, 30, 80, 120]))]
        for _ in range(r.choice([1, 1, 4])):
            own = list(base)
            for _ in range(r.randrange(4)):
                own[r.randrange(len(own))] = word()
            texts.append(" ".join(own))
    return texts[:size]


@pytest.mark.parametrize(("num", "n", "seed"), [(85, 4, 1), (80, 5, 2)])
def test_ngram_join_equals_brute_force(spark, num, n, seed):
    texts = corpus(seed, 150)
    ids = [3 * k for k in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts, strict=True)] + [(0, "one", 1), (None, "one two", 1)], "doc_id long, text string, component_id int")
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = components(len(sets), links)
    got = defaultdict(set)
    for r in ngram_join.join_ngrams(docs, n, num, 100).collect():
        got[r.doc_id].add((r.n_shingles, r.component_id))
    one = 3 * texts.index("one")
    for k, i in enumerate(ids[1:], 1):
        label = ids[want[k]] if ids[want[k]] != one and want[k] != texts.index("one") else 0  # the extra row 0 has the text of "one"
        assert got[i] == {(len(sets[k]), label)}, texts[k]
    assert got[None] == {(1, 3 * texts.index("one two"))} and got[0] == {(0, 0), (1, 0)}


def test_boundary_changes_no_link(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(corpus(3, 80))), "doc_id long, text string")
    results = []
    for boundary in (0, 63):
        monkeypatch.setattr(ngram_join, "choose_boundary", lambda *a, b=boundary: b)
        results.append(sorted(map(tuple, ngram_join.join_ngrams(docs).collect())))
    assert results[0] == results[1]
    assert ngram_join.join_ngrams(docs.limit(0)).count() == 0


def test_only_candidate_texts_are_read_again(spark, monkeypatch):
    """Shingles of a text that is in no candidate pair are made for the counters and for its signatures, not to verify."""
    texts = [t for t in corpus(5, 60) if t] + [" ".join(f"lone{i}x{k}" for k in range(30)) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    read, map_batches = [], ngram_join.map_batches
    monkeypatch.setattr(ngram_join, "map_batches", lambda df, fn, schema: read.append((schema, df.count())) or map_batches(df, fn, schema))
    got = {r.doc_id: r.component_id for r in ngram_join.join_ngrams(docs).collect()}
    assert all(got[k] == k for k in range(len(texts) - 200, len(texts))) and any(got[k] != k for k in got)
    again = [n for schema, n in read if schema == "node long, keys binary"]
    assert again and max(again) < len(texts) - 200


def test_representatives_keep_columns(spark):
    t = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(5, t, "x"), (2, t + " tail", "y"), (9, None, "z"), (7, "", "q")], "doc_id long, text string, source string")
    kept = ngram_join.keep_representatives(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 7, 9]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(8)
    long = " ".join(f"word{k % 37}x{k}" for k in range(150))
    lines = ["Shared line, once and for all.", "shared LINE once and for all", "***", "", "unique one", long, long.replace("x77", "y77"), long.replace("x9 ", "q9 "), "tail"]
    texts = ["\n".join(r.choice(lines) for _ in range(r.randrange(1, 7))) for _ in range(25)] + [None, "only here"]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(26, "only here", 1), (None, "tail", 1)], "doc_id long, text string, pos int")
    hashes = {(x.doc_id, x.pos): x.sh for x in line_dedup.line_hashes(docs).collect()}
    norms = {(x.doc_id, x.pos): x.norm for x in line_dedup.occurrences(docs).collect()}
    assert set(hashes) == set(norms)
    keys = sorted(norms)
    near = lambda a, b: bin((hashes[a] ^ hashes[b]) & (2**64 - 1)).count("1") <= 3 and edit_distance(norms[a], norms[b]) <= 0.2 * max(len(norms[a]), len(norms[b])) + 1e-9
    group = components(len(keys), [(i, j) for i in range(len(keys)) for j in range(i) if norms[keys[i]] == norms[keys[j]] or near(keys[i], keys[j])])
    gone = {k for i, k in enumerate(keys) if group[i] != i}
    got = line_dedup.dedup_lines(docs).collect()
    for row in got:
        if row.doc_id is None or row.doc_id == 26 or texts[row.doc_id] is None:
            assert row["__removed"] is None
            continue
        kept = [x for p, x in enumerate(texts[row.doc_id].split("\n")) if (row.doc_id, p) not in gone]
        assert row.text == "\n".join(kept)
    assert sorted(r.text for r in got if r.doc_id == 26) == ["only here"] * 2  # repeated rows are one document
    out = line_dedup.drop_repeated_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def edited(r, line, n):
    """``line`` after ``n`` random edits of single letters."""
    p = list(line)
    for _ in range(n):
        at, kind = r.randrange(len(p)), r.random()
        p[at : at + (kind > 0.3)] = "" if kind > 0.7 else r.choice("aeinrst")
    return "".join(p)


def test_similar_lines_meet_by_edit_similarity_alone(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("aeinrstlmo") for _ in range(r.choice([2, 4, 6, 9])))
    lines = []
    for n in [1, 2, 3] * 8 + [5, 8, 12] * 6 + [20, 40] * 3:
        words = [word() for _ in range(n)]
        own = " ".join(words)
        some = [word() if r.random() < 0.1 else w for w in words]
        lines += [own, edited(r, own, 1), edited(r, own, max(1, len(own) // 12)), " ".join(some)]
    lines += ["abcd efgh ijkl mnop qrst uvwx yz ab cd ef gh ij", "abcd efgh ijkl mnop qrsX uvwx yz ab cd ef gh ij"]
    lines += ["".join(chr(0x4E00 + r.randrange(3000)) for _ in range(60))]
    lines += [lines[-1][:30] + "é" + lines[-1][31:]]
    lines = list(dict.fromkeys(x.strip() for x in lines if x.strip()))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    norm = [" ".join(x.lower().split()) for x in lines]
    links = [(i, j) for i in range(len(norm)) for j in range(i) if edit_distance(norm[i], norm[j]) <= 0.2 * max(len(norm[i]), len(norm[j])) + 1e-9]
    group = components(len(lines), links)
    gone = {i for i in range(len(lines)) if group[i] != i}
    assert len(gone) > 60
    assert {x.doc_id for x in line_dedup.dedup_lines(docs).filter("__removed is not null").collect()} == gone


def test_keys_move_in_classes(spark, monkeypatch):
    """No table or shuffle holds the features of a line once a key; classes of keys change no result."""
    r = random.Random(11)
    words = ["".join(r.choices("abcdefghij", k=7)) for _ in range(60)]
    lines = [" ".join(r.choices(words, k=12)) for _ in range(40)]
    texts = ["\n".join(edited(r, x, r.choice((0, 1, 6))) for x in r.choices(lines, k=5)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name="t": held.append((name, df.columns)) or save(self, df, name))

    def removed():
        return sorted((x.doc_id, sorted(x["__removed"])) for x in line_dedup.dedup_lines(docs).filter("__removed is not null").collect())

    dealt = removed()
    assert len(dealt) > 30
    assert not [name for name, columns in held if "sig" in columns and "marks" in columns]
    assert len([name for name, _ in held if name == "buckets"]) == line_dedup.PASSES > 1
    monkeypatch.setattr(line_dedup, "PASSES", 1)
    assert removed() == dealt


def test_a_common_passage_brings_no_square_of_pairs(spark, monkeypatch):
    """Different lines around one passage are not all compared; similar ones among them still meet."""
    r = random.Random(3)
    word = lambda n: "".join(r.choices("abcdefghijklmnopqrst", k=n))
    passage = " ".join(word(12) for _ in range(6))
    lines = [" ".join([*(word(r.choice((6, 7, 8))) for _ in range(9)), passage, *(word(7) for _ in range(9))]) for _ in range(90)]
    origin = {x: x for x in lines} | {edited(r, x, 4): x for x in lines[:12]}
    lines = r.sample(list(origin), len(origin))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    held, save = {}, Scratch.save

    def spy(self, df, name="t"):
        out = save(self, df, name)
        if name.startswith("all-"):
            held[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "save", spy)
    gone = {x.doc_id for x in line_dedup.dedup_lines(docs).filter("__removed is not null").collect()}
    first = {}
    assert gone == {i for i, x in enumerate(lines) if first.setdefault(origin[x], i) != i} and len(gone) == 12
    assert held["all-rest-pairs"] < 3 * len(lines)


def test_middle_lines_that_are_apart_make_no_pairs(spark, monkeypatch):
    """Of lines of up to 75 characters around one passage only similar ones are left to be verified."""
    r = random.Random(9)
    word = lambda n: "".join(r.choices("abcdefghijklmnopqrst", k=n))
    passage = f"{word(17)} {word(18)}"
    lines = [f"{word(8)} {word(8)} {passage} {word(9)} {word(8)}" for _ in range(60)]
    lines += [edited(r, x, 3) for x in lines[:9]]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    held, save = {}, Scratch.save

    def spy(self, df, name="t"):
        out = save(self, df, name)
        if name == "all-rest-pairs":
            held[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "save", spy)
    assert {x.doc_id for x in line_dedup.dedup_lines(docs).filter("__removed is not null").collect()} == set(range(60, 69))
    assert held["all-rest-pairs"] <= 9


def around_a_passage():
    """60 different lines around one passage, and 8 near copies of them that differ in every word outside it."""
    r = random.Random(4)
    word = lambda n: "".join(r.choices("abcdefghijklmnopqrst", k=n))
    passage = " ".join(word(12) for _ in range(6))
    parts = [([word(7) for _ in range(4)], [word(7) for _ in range(4)]) for _ in range(60)]
    lines = [" ".join([*a, passage, *b]) for a, b in parts]
    return lines + [" ".join([*("z" + w[1:] for w in a), passage, *("z" + w[1:] for w in b)]) for a, b in parts[:8]]


def test_similar_lines_that_share_only_common_keys_meet(spark):
    docs = spark.createDataFrame(list(enumerate(around_a_passage())), "doc_id long, text string")
    assert {x.doc_id for x in line_dedup.dedup_lines(docs).filter("__removed is not null").collect()} == set(range(60, 68))


def test_pipeline_stage_drops_lines_that_share_only_common_keys(spark):
    lines = around_a_passage()
    docs = spark.createDataFrame([(k, f"{x}\n{k}", "en") for k, x in enumerate(lines)], "doc_id long, text string, lang string")
    got = {x.doc_id: x.text for x in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {k: f"{x}\n{k}" if k < 60 else str(k) for k, x in enumerate(lines)}


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_told_apart_by_contents_are_not_similar(spark, seed):
    """``unlike`` holds for no pair that ``similar`` takes, spaced or not, and for most others."""
    r = random.Random(seed)
    words = ["".join(r.choices("aeinrstlmo", k=r.choice((1, 2, 5, 8)))) for _ in range(300)]
    lines = [" ".join(r.choices(words, k=n)) for n in [5, 8, 12, 15, 20, 60] * 8] + ["".join(r.choices("abcdefgh", k=90)) for _ in range(4)]
    lines += [edited(r, x, max(1, len(x) // r.choice((4, 6, 10, 30)))) for x in lines]
    lines += [" ".join(edited(r, w, 1) if r.random() < 0.5 else w for w in x.split(" ")) for x in lines[:48]]
    lines = sorted({" ".join(x.split()) for x in lines if len(x) > 24})
    made = line_dedup.with_contents(spark.createDataFrame([(x, len(x)) for x in lines], "norm string, len int"))
    sides = made.select(F.struct("norm", "len", "words", "grams", "vocabulary").alias("s"))
    pairs = sides.select(F.col("s").alias("x")).crossJoin(sides.select(F.col("s").alias("y"))).filter("x.norm < y.norm and abs(x.len - y.len) <= 0.2 * greatest(x.len, y.len)")
    told = pairs.select(line_dedup.unlike(F.col("x"), F.col("y")).alias("unlike"), F.col("x.norm").alias("norm_a"), F.col("y.norm").alias("norm_b"))
    n = {(x[0], x[1]): x[2] for x in told.groupBy("unlike", line_dedup.similar(0.8).alias("similar")).count().collect()}
    assert (True, True) not in n and n[False, True] > 30 and n[True, False] > 5 * n[False, False]


def test_release_frees_the_last_shuffle(spark):
    scratch, env = Scratch(spark, "t"), spark.sparkContext._jsc.sc().env()
    held = lambda: env.mapOutputTracker().shuffleStatuses().size()
    scratch.release()
    time.sleep(1)
    before = held()
    scratch.save(spark.range(1000).repartition(4, "id").groupBy("id").count(), "x")
    assert held() > before
    scratch.release()
    for _ in range(50):
        if held() <= before:
            return
        time.sleep(0.1)
    raise AssertionError("shuffles of the last query are still there")


def test_dealt_buckets_link_as_one(spark):
    r = random.Random(5)
    rows = sorted({(r.randrange(40), r.randrange(120)) for _ in range(260)})
    df = spark.createDataFrame(rows, "sig long, node long").withColumn("rank", F.lit(0))
    value = spark.range(120).select(F.col("id").alias("node"), F.expr("cast(xxhash64(id) % 9 as int)").alias("v"))
    links = {}
    for parts in (1, 3):
        scratch = Scratch(spark, "t")
        dealt = [linkage.shared_among(scratch, df.filter(F.col("sig") % parts == k).withColumn("n", F.lit(1))) for k in range(parts)]
        out = linkage.links_among(scratch, dealt, lambda x, y: x["v"] - y["v"] <= 9, lambda p: p.join(value.toDF("a", "va"), "a").join(value.toDF("b", "vb"), "b").filter(F.abs(F.col("va") - F.col("vb")) <= 1).select("a", "b"), value)
        links[parts] = {(x.node, x.component) for x in linkage.connected_components(scratch, out).collect()}
    own = {x.node: x.v for x in value.collect()}
    pairs = {(a, b) for s, a in rows for t, b in rows if s == t and a < b and abs(own[a] - own[b]) <= 1}
    assert links[1] == links[3] == {(n, c) for n, c in enumerate(components(120, pairs)) if any(n in p for p in pairs)}


def test_lines_of_frequent_words_meet(spark):
    line = "alpha alpha beta " * 8
    docs = spark.createDataFrame([(1, line + "omega9x"), (2, line + "sigma7q"), (3, "quite another line of words")], "doc_id long, text string")
    a, b, _ = (r.sh for r in line_dedup.line_hashes(docs).orderBy("doc_id").collect())
    assert bin((a ^ b) & (2**64 - 1)).count("1") <= 3
    assert [r.doc_id for r in line_dedup.dedup_lines(docs).filter("__removed is not null").collect()] == [2]


def test_short_lines_are_compared_exactly(spark):
    r = random.Random(6)
    lines = sorted({"".join(r.choice("abb ") for _ in range(r.randrange(1, 20))).strip() for _ in range(260)} - {""})
    lines = sorted({" ".join(x.split()) for x in lines})
    df = spark.createDataFrame([(k, len(x), x) for k, x in enumerate(lines)], "h long, len int, norm string")
    got = {tuple(sorted(x)) for x in line_dedup.short_pairs(Scratch(spark, "t"), df).collect()}
    want = {(j, i) for i in range(len(lines)) for j in range(i) if edit_distance(lines[i], lines[j]) <= 0.2 * max(len(lines[i]), len(lines[j])) + 1e-9}
    assert got == want and len(want) > 5


def test_wide_and_narrow_counters_agree(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(40)
    lines = line_dedup.occurrences(docs)
    narrow, wide = (sorted(map(tuple, line_dedup.simhash(lines, k).collect())) for k in (4, 2))
    assert narrow == wide


@pytest.mark.parametrize("agree", [1, 2, 3])
def test_blocks_meet_within_the_distance(spark, agree):
    r = random.Random(agree)
    rows = []
    for _ in range(40):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), 3):
            b ^= 1 << bit
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(rows, "a long, b long").select(F.size(F.array_intersect(line_dedup.block_keys(F.col("a"), agree), line_dedup.block_keys(F.col("b"), agree))).alias("n"))
    assert df.filter("n = 0").count() == 0


def test_warc_round_trip_and_pushdown(spark):
    body = "<p>" + "x" * 200
    pages = [(4, "u4", body), (2, "u2", body), (9, "u9\r\nbad", "short"), (8, None, "short"), (7, "u7", None), (2, "u2", body), (None, "n", "é\r\n\r\nend")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.archive_pages(df, path := Scratch(spark, "warc").path("a"))
    read = warc.read_archive(spark, path)
    rows = read.collect()
    assert len(rows) == 7 and sorted(r.record_type for r in rows) == ["response"] * 6 + ["revisit"]
    assert {bytes(r.payload).decode() for r in rows if r.record_type == "response"} == {body, "short", "", "é\r\n\r\nend"}
    revisit = read.filter("record_type = 'revisit'").collect()
    assert [(r.record_id, r.refers_to, r.payload) for r in revisit] == [("<urn:page:4>", "<urn:page:2>", None)]
    assert all(r.payload is None for r in warc.read_archive(spark, path, payload=False).collect())
    empty = Scratch(spark, "warc").path("e")
    warc.archive_pages(df.limit(0), empty)
    assert warc.read_archive(spark, empty).count() == 0


def test_foreign_archives_are_read(tmp_path):
    import gzip
    import io

    data = b"".join(gzip.compress(f"WARC/1.0\r\nWARC-Type: {t}\r\nContent-Length: 0\r\n\r\nHTTP/1.1 200 OK\r\n\r\n{'z' * n}\r\n\r\n".encode()) for t, n in (("response", 50_000), ("metadata", 5), ("response", 3)))
    found = [(h["warc-type"], len(m.block())) for h, m in warc.Members(io.BytesIO(data), len(data))]
    assert found == [("response", 50_000), ("metadata", 5), ("response", 3)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df, want = QUERIES[name](spark, DIR), c.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    key = lambda rows, columns: sorted(str([r[columns.index(x)] for x in sorted(columns)]) for r in rows)
    assert key([tuple(r) for r in df.collect()], df.columns) == key(want.fetchall(), want.columns)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = Scratch(spark, "t").save(stage(spark, kept, DIR), name)
        assert kept.columns == docs.columns
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, DIR)
    total = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    assert total.count() == kept.count() > 50 and total.filter("n <> t").count() == 0


def test_marks_of_many_tasks_do_not_wrap(spark):
    import numpy as np

    def fill(table, batch):
        table[5] = 1

    df = spark.range(0, 256, 1, 256).select("id")
    assert linkage.gather_cells(df, fill, 64, "u1", np.bitwise_or)[5] == 1
    assert linkage.gather_cells(df, fill, 64, "<u8")[5] == 256


def test_ends_tell_pairs_around_a_passage_apart_and_lose_none(spark):
    """Lines that hold one passage in different places are told apart by their ends; similar ones, however edited, are not."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("aeinrstlmoüß", k=r.choice((2, 4, 6, 9))))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(40)
    apart = [(f"{text(a)} {passage} {text(35 - a)}", f"{text(b)} {passage} {text(35 - b)}") for a, b in [(0, 35), (5, 25), (30, 10), (35, 12), (18, 2)] * 4]
    lines = [text(n) for n in (14, 30, 90) * 8]
    near = [(x, edited(r, x, int(len(x) * share))) for x in lines for share in (0.05, 0.12, 0.16)]
    near += [(x, x[int(len(x) * 0.1) :] + x[: int(len(x) * 0.09)][::-1]) for x in lines] + [(x, x[int(len(x) * 0.19) :]) for x in lines] + [(x[: int(len(x) * 0.81)], x) for x in lines]
    df = spark.createDataFrame([(True, *x) for x in near] + [(False, *x) for x in apart], "near boolean, norm_a string, norm_b string")
    exact = F.expr("levenshtein(norm_a, norm_b, cast(floor(greatest(length(norm_a), length(norm_b)) * 0.2 + 1e-9) as int)) >= 0")
    n = {tuple(x[:3]): x[3] for x in df.groupBy("near", exact.alias("similar"), line_dedup.ends_apart(0.8).alias("apart")).count().collect()}
    assert not any(similar and told for _, similar, told in n) and n[True, True, False] >= 96
    assert n[False, False, True] >= 18


def test_classes_are_dropped_one_by_one(spark):
    scratch = Scratch(spark, "t")
    df = spark.range(100).select("id", F.when(F.col("id") % 2 == 0, "x").alias("__class_of"))
    for rows, n in ((df, 100), (df.limit(0), 0), (df.filter("id % 4 = 1"), 25)):
        parts = scratch.save_classes(rows, F.col("id"), 4, "classes")
        assert len(parts) == 4 and sum(x.count() for x in parts) == n and all(x.columns == df.columns for x in parts)
        scratch.drop(parts[0])
        assert sorted(x.id for p in parts[1:] for x in p.collect()) == sorted(x.id for x in rows.collect() if x.id % 4)


def test_lines_go_class_by_class(spark, monkeypatch):
    """When the last class of lines is collapsed, the others are gone."""
    gone, drop = [], Scratch.drop
    monkeypatch.setattr(Scratch, "drop", lambda self, *tables: (gone.extend(t._scratch_path for t in tables if "-lines" in getattr(t, "_scratch_path", "")), drop(self, *tables))[1])
    docs = spark.createDataFrame([(k, f"the same line in every one of them\nand line {k} of its own"[: 60 + k]) for k in range(9)], "doc_id long, text string")
    assert line_dedup.dedup_lines(docs).filter("__removed is not null").count() == 8
    assert len(gone) == line_dedup.PASSES


def test_freed_memory_goes_back(spark):
    from tallymark.llm.common import trim_native_heap

    assert trim_native_heap(spark) in (True, False)
