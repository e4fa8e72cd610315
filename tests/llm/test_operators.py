"""The training-data operators against brute force, on edge cases and on the smallest tables."""

import base64
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from optionlake.llm import (
    brown,
    decontaminate,
    lines,
    minhash,
    packing,
    pii,
    quality,
    queries,
    rules,
    substrings,
    warc,
)

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, node string, "
          "bucket long, spans string, n_words long")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
BODY = " ".join(f"alpha{i} beta{i * 7 % 13}" for i in range(60))
EDGES = [
    (0, None), (1, ""), (2, "  \n\t "), (3, "one"), (4, BODY), (5, BODY), (6, BODY + " tail"),
    (7, "x\n\nx\ny y\nx"), (None, BODY), (8, LONG), (9, "a b c d e f g h " * 6), (9, "a b c d e f g h " * 6),
    (10, "é\x0bñ ü z  q"), (11, "mail bob@x.com, 1.2.3.4 +1 (203) 555-8282 4111 1111 1111 1111"),
    (12, ""), (13, "Some\nlines here\n" + BODY),
]


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, t, "en", "s", len(t or ""), "n", 1, "s", 2) for i, t in EDGES]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def empty(df):
    return df.filter("doc_id = -5")


def words(text):
    return WORD.findall(text or "")


# --- substring dedup -----------------------------------------------------------------------

def brute_substrings(rows, width=20):
    first = {}
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, zlib.crc32((r[1] or "").encode()) >> 1))
    for i, text in order:
        w = words(text)
        for s in range(len(w) - width + 1):
            first.setdefault(tuple(w[s:s + width]), (i, text, s))
    out = []
    for i, text in rows:
        w = words(text)
        gone = set()
        for s in range(len(w) - width + 1):
            if first[tuple(w[s:s + width])] != (i, text, s):
                gone.update(range(s, s + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("table", ["edges", "small"])
def test_substrings_match_brute_force(spark, request, table):
    docs = request.getfixturevalue(table)
    found = substrings.deduplicated(spark, docs).withColumn("sha", F.sha2("kept_text", 256))
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.sha) for r in found.collect()), key=str)
    assert got == brute_substrings(texts(docs))


def test_substring_factors_name_equal_earlier_text(spark, small):
    docs = dict(texts(small))
    for row in substrings.deduplicated(spark, small).filter(F.size("factors") > 0).collect():
        own = words(docs[row.doc_id])
        for f in row.factors:
            ref = words(docs[f.ref_doc_id])[f.ref_start:f.ref_start + f.length]
            assert ref == own[f.start:f.start + f.length]
            assert (f.ref_doc_id, f.ref_start) < (row.doc_id, f.start)


def test_repeated_rows_have_the_factors_of_one_row(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text)] + [(2, text)] * 3, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed, tuple(tuple(f) for f in r.factors))
                 for r in substrings.deduplicated(spark, docs).collect())
    assert got == [(1, 0, ())] + [(2, 60, ((0, 60, 1, 0),))] * 3


# --- rules ---------------------------------------------------------------------------------

def brute_rules(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = {k for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for k in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed)


@pytest.mark.parametrize("table", ["edges", "small"])
def test_rules_match_brute_force(request, table):
    docs = request.getfixturevalue(table)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                   r.base_failed) for r in rules.judged(docs).collect()), key=str)
    assert got == sorted(((i, *brute_rules(t)) for i, t in texts(docs)), key=str)


def test_ablations_count_ledger_bits(small):
    ledger = rules.ledger(small).cache()
    bits = [r.failures for r in ledger.select("failures").collect()]
    for row in rules.ablations(ledger).collect():
        policy = rules.POLICIES[row.policy]
        mask, bit = rules.bits_of(policy.rules), rules.bits_of([row.rule])
        assert row.failing == sum(b & bit > 0 for b in bits)
        assert row.rejected_alone == sum(b & mask == bit for b in bits)
        assert row.kept_without == sum(b & mask & ~bit == 0 for b in bits)


def test_policy_is_applied_to_stored_bits(small):
    ledger = rules.ledger(small)
    base = rules.apply_policy(ledger, rules.POLICIES["1-base"])
    assert base.filter("kept").count() >= rules.judged(small).filter("kept").count() > 0


# --- packing -------------------------------------------------------------------------------

@pytest.mark.parametrize("table", ["edges", "small"])
def test_packing_round_trip(spark, request, table):
    from tokenizers import Tokenizer

    import public_tokenizers

    docs = request.getfixturevalue(table)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    settings = packing.PackSettings(length=256, rests_per_bin=64)
    pieces = packing.packed(spark, docs, *packing.public_vocabulary(), settings).collect()
    want = collections.Counter()
    for i, text in texts(docs):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        want[i, len(ids)] += 1
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id, p.doc_tokens].append((p.start, p.length))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert sum(p.length for p in pieces) == sum(n * count for (_, n), count in want.items())
    for key, count in want.items():
        starts = collections.Counter(range(s, s + n) for s, n in by_doc[key])
        covered = collections.Counter(k for r, c in starts.items() for k in r for _ in range(c))
        assert covered == {k: count for k in range(key[1])}
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= settings.length
    bins = {s >> 40 for s in by_sequence}
    padding = sum(settings.length - sum(n for _, n in parts) for parts in by_sequence.values())
    assert padding < settings.length * len(bins)


def test_packing_checksums(spark, small):
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = dict(texts(small)) | {-1: "hello <|endoftext|> you", -2: "<|endoftext|><|endoftext|>x <|endof"}
    told = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for p in packing.packed(spark, told, *packing.public_vocabulary()).collect():
        ids = tokenizer.encode(docs[p.doc_id] or "", add_special_tokens=False).ids + [1]
        piece = b"".join(x.to_bytes(4, "little") for x in ids[p.start:p.start + p.length])
        assert (zlib.crc32(piece), len(ids)) == (p.ids_crc32, p.doc_tokens)


def test_rows_alike_spread_over_bins(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    settings = packing.PackSettings(rests_per_bin=500)
    pieces = packing.packed(spark, docs, *packing.public_vocabulary(), settings).select("sequence_id")
    bins = collections.Counter(r.sequence_id >> 40 for r in pieces.collect())
    assert len(bins) == 6 and max(bins.values()) < 700


# --- WARC ----------------------------------------------------------------------------------

def test_warc_round_trip(spark, folder):
    pages = spark.createDataFrame(
        [(1, "http://a", "x"), (2, "http://b", "x"), (3, "http://c", None), (4, None, ""),
         (5, "http://d\r\nevil: 1", "é" * 10), (None, "http://e", "only"), (6, "u", "WARC/1.1\r\n\r\n")],
        "page_id long, url string, html string")
    warc.write_archives(spark, pages, folder, file_bytes=200)
    got = {r.page_id: r for r in warc.read_archives(spark, folder).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, None}
    assert [(i, got[i].record_type, got[i].refers_to) for i in (1, 2, 3, 4, 5)] == [
        (1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None),
        (5, "response", None)]
    assert got[5].payload_bytes == 20 and bytes(got[5].payload).decode() == "é" * 10
    assert got[1].payload_digest == base64.b32encode(hashlib.sha1(b"x").digest()).decode()
    assert warc.read_gaps(spark, folder).count() == 0


def test_warc_salvage_logs_gaps():
    good = [warc.member(warc.record(i, "u", b"payload %d" % i * 50, None)) for i in range(4)]
    broken = bytearray(good[1])
    broken[len(broken) // 2] ^= 0xFF
    data = good[0] + bytes(broken) + b"junk" + good[2] + good[3][:-9]
    rows, gaps = [], []
    for row, gap in warc.salvage(data):
        (rows if row else gaps).append(row or gap)
    # the last member lacks its end, but its record is whole and its digest agrees
    assert [r["page_id"] for r in rows] == [0, 2, 3]
    assert [g[:2] for g in gaps] == [(len(good[0]), len(good[0] + broken) + 4),
                                     (len(data) - len(good[3]) + 9, len(data))]


def test_warc_salvages_plain_records():
    plain = [warc.record(i, "u", b"p%d" % i, None) for i in range(3)]
    bad = plain[1].replace(b"p1", b"px")
    found = list(warc.salvage(plain[0] + bad + plain[2]))
    assert [r["page_id"] for r, _ in found if r] == [0, 2]
    assert [g[2] for _, g in found if g] == ["wrong digest"]


def found_in(data):
    found = list(warc.salvage(data))
    return [r["page_id"] for r, _ in found if r], [g for _, g in found if g]


def test_warc_salvages_inside_members():
    plain = [warc.record(i, "u", b"payload %d" % i * 50, None) for i in range(4)]
    bad = plain[1].replace(b"payload 1", b"payloax 1", 1)
    whole = warc.member(plain[0] + bad + plain[2])
    ids, gaps = found_in(whole + warc.member(plain[3]))
    assert ids == [0, 2, 3] and [g[:2] for g in gaps] == [(0, len(whole))]
    assert "wrong digest" in gaps[0][2]
    for level in (0, 1):  # at level 0 the records lie open in the file and are still given once
        cut = warc.member(plain[0] + plain[1] + plain[2], level)[:-20]
        ids, gaps = found_in(cut + warc.member(plain[3]))
        assert ids[:2] == [0, 1] and ids[-1] == 3 and len(ids) == len(set(ids))
        assert gaps[-1][1] <= len(cut)
        ids, gaps = found_in(cut)
        assert ids[:2] == [0, 1] and len(ids) == len(set(ids)) and gaps[-1][1] == len(cut)


def test_warc_reads_other_writers(spark, folder):
    message = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hi</p>"

    def foreign(kind, block, *extra):
        lines = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:uuid:1>",
                 b"Content-Length: %d" % len(block), *extra]
        return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = b"Content-Type: application/http; msgtype=response"
    digest = b"WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"<p>hi</p>").digest())
    wrong = b"WARC-Block-Digest: sha1:" + hashlib.sha1(b"other").hexdigest().encode()
    data = (warc.member(foreign(b"warcinfo", b"software: x")) + warc.member(foreign(
        b"response", message, http, digest)) + warc.member(foreign(b"response", message, http, wrong)))
    with open(folder + "/a.warc.gz", "wb") as out:
        out.write(data)
    got = warc.read_archives(spark, folder).orderBy("record_type").collect()
    assert [(r.record_type, bytes(r.payload), r.page_id, r.record_id) for r in got] == [
        ("response", b"<p>hi</p>", None, "<urn:uuid:1>"),
        ("warcinfo", b"software: x", None, "<urn:uuid:1>")]
    assert got[0].payload_bytes == 9
    assert warc.read_gaps(spark, folder).count() == 1


def test_warc_least_size_and_empty_table(spark, folder):
    pages = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy")], "page_id long, url string, html string")
    assert warc.marked(pages, 3).filter("original is not null").count() == 0
    warc.write_archives(spark, empty(pages.withColumn("doc_id", F.lit(1))), folder)
    assert warc.read_archives(spark, folder).count() == 0


# --- near-duplicates -----------------------------------------------------------------------

def exact_groups(rows, idf, settings):
    """Union-find over all pairs of distinct texts by the same weighted Jaccard similarity."""
    import numpy as np
    import pyarrow as pa

    from optionlake.llm import textbytes

    distinct = sorted({t for _, t in rows if t})
    sets = []
    for text in distinct:
        (_, _, chunk), = textbytes.chunks(pa.array([text]))
        _, ids, w = minhash.weighted(*minhash.shingles(chunk, settings.width), idf)
        sets.append(dict(zip(ids.tolist(), w.astype(np.float64).tolist(), strict=True)))
    root = list(range(len(distinct)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(distinct)):
        for j in range(i):
            common = sets[i].keys() & sets[j].keys()
            both = sum(min(sets[i][k], sets[j][k]) for k in common)
            all_ = sum(sets[i].values()) + sum(sets[j].values()) - both
            if all_ and both / all_ >= settings.threshold:
                root[find(i)] = find(j)
    return {t: find(i) for i, t in enumerate(distinct)}


def test_near_duplicates_match_all_pairs(spark, small):
    extra = []
    for n, (i, t) in enumerate(texts(small)[:30]):
        w = (t or "").split(" ")
        if len(w) > 120:
            w[5 + n] = "changed"
            extra.append((5000 + i, " ".join(w)))
    docs = small.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    settings = minhash.NearSettings()
    idf = minhash.feature_weights(*minhash.document_frequencies(docs, 5), settings.idf_strength)
    rows = texts(docs)
    groups = exact_groups(rows, idf, settings)
    members = collections.defaultdict(list)
    for i, t in rows:
        members[groups.get(t, t)].append(i)
    want = {i: min(ids) for ids in members.values() for i in ids}
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark, docs).collect()}
    assert got == want
    assert len(extra) > 3 and all(got[i] != i for i, _ in extra)


def test_near_duplicates_send_their_weights_once(spark, small, monkeypatch):
    sent, send = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast",
                        lambda self, value: sent.append(len(value)) or send(self, value))
    assert minhash.near_duplicates(spark, small).count() == small.count()
    assert sent == [1 << minhash.FEATURE_BITS]


def test_near_duplicates_edges(spark, edges):
    got = {}
    for r in minhash.near_duplicates(spark, edges).collect():
        got.setdefault(r.doc_id, []).append((r.class_id, r.stays))
    assert got[4] == [(4, True)] and got[5] == [(4, False)] and got[None] == [(4, False)]
    assert got[1] == [(1, True)] and got[12] == [(1, False)] and got[0] == [(0, True)]
    assert got[9] == [(9, True), (9, True)]
    kept = minhash.representatives(spark, edges)
    assert kept.columns == edges.columns
    assert minhash.near_duplicates(spark, empty(edges)).count() == 0


def test_bucket_links_find_every_pair_of_a_bucket(spark):
    """One bucket of points on a line: similarity 1 - distance is a metric, so no link is lost."""
    import random

    from optionlake.llm.grouping import bucket_links
    from optionlake.sources.stages import StageTables

    points = {i: random.Random(i).random() * 6 for i in range(150)}
    table = spark.createDataFrame(list(points.items()), "node long, x double")

    def verify(pairs):
        joined = pairs.join(table.withColumnsRenamed({"node": "a", "x": "xa"}), "a").join(
            table.withColumnsRenamed({"node": "b", "x": "xb"}), "b")
        return joined.select("a", "b", F.greatest(F.lit(0.0), 1 - F.abs(F.col("xa") - F.col("xb"))).alias("sim"))

    members = table.select(F.lit(1).alias("bucket"), "node")
    got = {r.node: r.component for r in bucket_links(StageTables(spark), members, verify, 0.8, "t").collect()}
    order = sorted(points, key=points.get)
    want, group = {}, [order[0]]
    for a, b in [*zip(order, order[1:], strict=False), (order[-1], None)]:
        if b is None or points[b] - points[a] > 0.2:
            want |= {i: min(group) for i in group}
            group = []
        group.append(b)
    assert {i: got.get(i, i) for i in points} == want


# --- lines ---------------------------------------------------------------------------------

def test_lines_match_all_pairs(spark, small):
    docs = small.limit(60)
    rows = sorted(texts(docs))
    first, sets = {}, {}
    for i, t in rows:
        for at, line in enumerate((t or "").split("\n")):
            if WORD.search(line):
                first.setdefault(line, (i, at))
                sets[line] = {line[k:k + 5] for k in range(max(len(line) - 4, 1))}
    names = list(sets)
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(names)):
        for b in range(a):
            x, y = sets[names[a]], sets[names[b]]
            if len(x & y) >= 0.8 * len(x | y):
                root[find(names[a])] = find(names[b])
    keeper = {}
    for name in names:
        keeper[find(name)] = min(keeper.get(find(name), (1 << 60, 0)), first[name])
    want = {}
    for i, t in rows:
        want[i] = [at for at, line in enumerate((t or "").split("\n"))
                   if WORD.search(line) and keeper[find(line)] != (i, at)]
    got = {r.doc_id: list(r.removed_lines) for r in lines.clean_lines(spark, docs).collect()}
    assert got == want


def test_lines_edges(spark, edges):
    got = {}
    for r in lines.clean_lines(spark, edges).collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got[0] == [None] and got[1] == [""] and got[2] == ["  \n\t "]
    assert got[7] == ["x\n\ny y"]
    assert got[None] == [BODY] and got[4] == [""]  # a null doc_id comes first
    assert got[9] == ["a b c d e f g h " * 6] * 2
    assert lines.clean_lines(spark, empty(edges)).count() == 0


def test_lines_many_equal_and_long(spark):
    """A document of very many equal lines, and lines longer than a chunk that differ in one place."""
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(700_000))
    rows = [(1, "same line here\n" * 40_000 + "last"), (2, "other\nsame line here"),
            (3, long), (4, long[:1000] + "#" + long[1000:]), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, len(r.removed_lines)) for r in lines.clean_lines(spark, docs).collect()}
    assert got == {1: ("same line here\n\nlast".replace("\n\n", "\n"), 39_999), 2: ("other", 1),
                   3: (long, 0), 4: ("", 1), 5: (None, 0)}


def test_lines_link_by_character_grams(spark):
    """Brute force over all character 5-grams; word shingles link none of these pairs."""
    rows = [(1, "the quick brown fox jumps over the lazy dog near the river"),
            (2, "the quick brown fox jumps over the lazy dig near the river"),
            (3, "https://example.org/a/long/path/without/any/space/index.html?id=1"),
            (4, "https://example.org/a/long/path/without/any/space/index.html?id=2"),
            (5, "".join(chr(0x4E00 + i) for i in range(40))),
            (6, "".join(chr(0x4E00 + i) for i in range(41))),
            (7, "\U0001F600abc" * 3 + "defghijklmnopqrstuvwxyz0123456789"),
            (8, "\U0001F600abc" * 3 + "defghijklmnopqrstuvwxyz012345678"),
            (9, "abc"), (10, "abcd"), (11, "abcde"), (12, "abcdef"), (13, "something else altogether")]
    grams = {i: {t[k:k + 5] for k in range(max(len(t) - 4, 1))} for i, t in rows}
    want = {i: int(any(len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])
                       for j in range(1, i))) for i in grams}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: len(r.removed_lines) for r in lines.clean_lines(spark, docs).collect()}
    assert got == want and sum(want.values()) == 4


# --- decontamination -----------------------------------------------------------------------

def edit_distance_inside(item, text):
    """Least edits of ``item`` against any part of ``text``."""
    cost = [0] * (len(text) + 1)
    for r, c in enumerate(item, 1):
        now = [r]
        for j, d in enumerate(text, 1):
            now.append(min(cost[j - 1] + (c != d), cost[j] + 1, now[-1] + 1))
        cost = now
    return min(cost)


def test_contaminations_match_brute_force(spark):
    item = "The quick brown fox jumps over the lazy dog, while seven wizards mix black quartz in jars."
    other = "Pack my box with five dozen liquor jugs and send them\nto the quay before the tide has gone."
    rows = [(1, f"lead {item} tail"), (2, "x " + item.upper().replace("FOX", "F0X") + " y"),
            (3, item[:40]), (4, item[:20] + item[24:60] + "zz" + item[60:]), (5, "nothing"), (6, None),
            (7, ""), (8, (other + " ") * 3), (9, item[:10] + "?" * 9 + item[19:]), (10, "abc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, other), (3, None), (4, " "), (5, "abc")],
                                  "item_id long, text string")
    settings = decontaminate.MatchSettings()

    def fold(t):
        return re.sub(r"[\t-\r]", " ", re.sub("[A-Z]", lambda m: m[0].lower(), t))

    want = {(i, j): e for i, t in rows for j, x in ((1, item), (2, other), (5, "abc"))
            if t and (e := edit_distance_inside(fold(x), fold(t))) <= decontaminate.allowed(len(x), settings)}
    found = decontaminate.contaminations(spark, docs, bench).collect()
    got = {}
    for r in found:
        got[r.doc_id, r.item_id] = min(r.edits, got.get((r.doc_id, r.item_id), 99))
    assert got == want
    assert sum(r.doc_id == 8 for r in found) == 3
    spans = {(r.doc_id, r.item_id): (r.start, r.end) for r in found}
    assert spans[1, 1] == (5, 5 + len(item))
    clean = {r.doc_id for r in decontaminate.clean_documents(spark, docs, bench).collect()}
    assert clean == {i for i, _ in rows} - {i for i, _ in want}
    assert decontaminate.contaminations(spark, docs, empty(bench.withColumn("doc_id", F.lit(1)))).count() == 0


def test_rows_are_dropped_by_id_and_text(spark):
    item = "The quick brown fox jumps over the lazy dog, while seven wizards mix black quartz in jars."
    rows = [(None, f"lead {item}"), (None, "clean"), (1, f"{item} tail"), (1, "clean too"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = texts(decontaminate.clean_documents(spark, docs, bench))
    assert sorted(kept, key=str) == sorted([rows[1], rows[3], rows[4]], key=str)
    rows = [(1, BODY), (2, BODY + " tail"), (2, "unlike text"), (None, BODY + " end"), (None, "alone"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = texts(minhash.representatives(spark, docs))
    assert sorted(kept, key=str) == sorted([rows[0], rows[2], rows[4], rows[5]], key=str)


# --- personal data -------------------------------------------------------------------------

KIND = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    out = []
    for order, (kind, pattern) in enumerate(KIND.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            double = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0,
                  "card": 14 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in double) % 10 == 0,
                  "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_pii_base_spans(spark, small, folder):
    odd = ["a@b.c_d@e.f", "x@y", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.004", "9" * 5000, "+1 2", "1 1 " * 3000,
           "é +1 (203) 555-8282 é 4111-1111-1111-1111 4111 1111 1111 1112", "a" * 40_000, "a.b@c.d@e.f@g.h",
           "+12345678901 +1234567890123456 @ . bob@mail.example.com,x@z-.9", "12 34  5678"]
    docs = small.select("doc_id", "text").union(spark.createDataFrame(
        [(9000 + i, t) for i, t in enumerate([*odd, "", None])], "doc_id long, text string"))
    docs.write.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r for r in queries.op9_pii(spark, folder).collect()}
    for i, text in texts(docs):
        want = brute_pii(text)
        row = got[i]
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (i, row.spans, want)
        counts = collections.Counter(s.split(":")[0] for s in want)
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [counts[k] for k in KIND]
        assert set(want) <= set(row.spans.split(",")) | {""}
    assert pii.personal_data(spark, empty(docs)).count() == 0


def test_em_finds_the_reliable_labeler():
    patterns = [((1, 1), 80), ((-1, -1), 80), ((1, -1), 20), ((-1, 1), 2)]
    p, rates = pii.reliabilities(patterns)
    assert p[0] > 0.9 > 0.1 > p[1]
    assert abs(sum(rates[1][0].values()) - 1) < 1e-9


# --- language model ------------------------------------------------------------------------

@pytest.mark.parametrize("table", ["edges", "small"])
def test_brown_base_scores(spark, request, table):
    docs = request.getfixturevalue(table)
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    settings = brown.BrownSettings(classes=6, frequent=40, shapes=8, local=50, sweeps=3)
    rows = texts(docs)

    def toks(text):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return [*words(lowered), None]

    def out(i):
        return i is not None and zlib.crc32(str(i).encode()) % 7 == 2

    count = collections.Counter(t for i, text in rows if not out(i) for t in toks(text))
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), out(i), len(toks(t)), sum(count[x] > 0 for x in toks(t)), n,
                   round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in toks(t)), 6)) for i, t in rows)
    scored = brown.scores(spark, docs, held, settings).collect()
    assert want == sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens,
                           round(r.base_score, 6)) for r in scored)
    assert all(r.score < 0 and r.perplexity > 1 for r in scored)


def test_brown_beats_unigrams(spark, small):
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    rows = brown.scores(spark, small, held).filter("held_out").agg(
        F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert rows.s > rows.b


def test_brown_places_rare_words_by_context(spark):
    """Words outside the frequent ones, of one shape, get the class of the words they stand for."""
    from optionlake.sources.stages import StageTables

    animals, colours = [f"a{i:03}xx" for i in range(20)], [f"c{i:03}xx" for i in range(20)]
    rows = [(i, " ".join(f"the dog runs a red shines the {animals[(i + k) % 20]} runs "
                         f"a {colours[(i * 7 + k) % 20]} shines" for k in range(2))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    settings = brown.BrownSettings(classes=8, frequent=6, shapes=8)
    _, table = brown.train(spark, docs, settings, StageTables(spark))
    classes = {r.word: r["class"] for r in table.collect()}
    assert len(classes) == 47  # 40 words, six frequent ones and the end token

    import numpy as np
    import pyarrow as pa

    from optionlake.llm import textbytes

    def of(names):
        (_, _, chunk), = textbytes.chunks(pa.array([" ".join(names)]))
        return {classes[int(h)] for h in chunk.word_hashes(fold_case=True).view(np.int64)}

    assert of(animals) == of(["dog"]) != of(colours) == of(["red"])


def test_brown_scores_follow_from_classes(spark):
    """The score is the sum of class transitions and emissions, and both are distributions."""
    from optionlake.llm import textbytes
    from optionlake.sources.stages import StageTables

    rows = [(i, " ".join(f"w{(i * k * k + 3 * k) % 37}{'xyz'[k % 3]}" for k in range(i % 9 + 1)))
            for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    settings = brown.BrownSettings(classes=6, frequent=10, shapes=4, local=20)
    _, table = brown.train(spark, docs, settings, StageTables(spark))
    by_hash = {r.word: (r.n, r["class"]) for r in table.collect()}

    def known(text):
        (_, _, chunk), = textbytes.chunks(pa.array([text]))
        return [*(by_hash[int(h)] for h in chunk.word_hashes(fold_case=True).view(np.int64)),
                by_hash[int(brown.END)]]

    moves, mass, kinds = collections.Counter(), collections.Counter(), collections.Counter()
    for n, c in by_hash.values():
        mass[c] += n
        kinds[c] += 1
    for _, text in rows:
        of = [c for _, c in known(text)]
        moves.update(zip([settings.classes - 1, *of[:-1]], of, strict=True))
    a, count = settings.smoothing, settings.classes

    def move(c, d):
        return (moves[c, d] + a) / (sum(moves[c, x] for x in range(count)) + a * count)

    def emit(n, c):
        return (n + 1) / (mass[c] + kinds[c] + 1)

    for c in range(count):
        assert abs(sum(move(c, d) for d in range(count)) - 1) < 1e-12
        unknown = 1 / (mass[c] + kinds[c] + 1)
        assert abs(sum(emit(n, d) for n, d in by_hash.values() if d == c) + unknown - 1) < 1e-12
    want = {}
    for i, text in rows:
        seen = known(text)
        want[i] = sum(math.log10(move(c, d)) + math.log10(emit(n, d)) for c, (n, d) in zip(
            [settings.classes - 1, *(c for _, c in seen[:-1])], seen, strict=True))
    got = {r.doc_id: r.score for r in brown.scores(spark, docs, None, settings).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_brown_contexts_of_words():
    """Every word that is not fixed has as many classes before and after it as occurrences."""
    from optionlake.llm import textbytes

    texts_ = ["a b c a b", "", "b a c d e", "e e e a b"] * 3
    (_, _, chunk), = textbytes.chunks(pa.array([" ".join(texts_)]))
    words_ = collections.Counter(chunk.word_hashes(fold_case=True).tolist())
    fixed = np.array(sorted(words_)[:2], np.uint64)
    units = brown.Units(fixed, 4)
    known = brown.Classes(units, np.arange(7) % 3, fixed, np.array([0, 1]))
    out = collections.Counter()
    for batch in brown._contexts(known, fixed, 3)(pa.record_batch({"text": pa.array([t])}) for t in texts_):
        for r in batch.to_pylist():
            out[r["word"], r["slot"]] += r["n"]
    assert sum(n for (_, slot), n in out.items() if slot == 6) == sum(words_.values()) + len(texts_)
    for word, n in words_.items():
        key = int(np.uint64(word).view(np.int64))
        for slots in (range(3), range(3, 6)):
            assert sum(out[key, x] for x in slots) == (0 if word in fixed else n)


def test_brown_contexts_take_one_row_an_occurrence():
    """Joint slots give the counts of the classes before and after, in half of the rows."""
    rng = np.random.default_rng(11)
    texts_ = [" ".join(f"w{x}" for x in rng.integers(0, 60, rng.integers(0, 9))) for _ in range(80)]
    known = brown.Classes(brown.Units(np.empty(0, np.uint64), 4), np.arange(5) % 3,
                          np.empty(0, np.uint64), np.empty(0, np.int64))

    def rows(joint):
        found = [pa.record_batch({"text": pa.array([t])}) for t in texts_]
        return [r for b in brown._contexts(known, np.empty(0, np.uint64), 3, joint)(iter(found))
                for r in b.to_pylist()]

    apart, both = collections.Counter(), collections.defaultdict(list)
    for r in (one := rows(False)):
        if r["slot"] < 6:
            apart[r["word"], r["slot"]] += r["n"]
    for r in (two := rows(True)):
        both[r["word"]].append(r["n"] << 16 | r["slot"])
    assert sum(r["slot"] < 9 for r in two) < 0.6 * sum(r["slot"] < 6 for r in one)
    assert [(r["word"], r["n"]) for r in one if r["slot"] == 6] == [
        (r["word"], r["n"]) for r in two if r["slot"] == 9]
    counts = brown._neighbours(pa.array(both.values(), pa.list_(pa.int64())), 3)
    assert all(counts[i, x] == apart[word, x] for i, word in enumerate(both) for x in range(6))


def test_exchange_ends_where_no_move_helps():
    import numpy as np

    rng = np.random.default_rng(3)
    bigrams = rng.integers(0, 30, (12, 12)).astype(float) * (rng.random((12, 12)) < 0.4)

    def value(of):
        member = np.eye(4)[of]
        table = member.T @ bigrams @ member
        parts = [brown._xlogx(x).sum() for x in (table, table.sum(0), table.sum(1))]
        return parts[0] - parts[1] - parts[2]

    of = brown.exchange(bigrams, 4, 50)
    assert of[-1] == 3 and set(of[:-1]) <= {0, 1, 2}
    for unit in range(11):
        for to in range(3):
            moved = of.copy()
            moved[unit] = to
            assert value(moved) <= value(of) + 1e-6


def test_empty_training_table(spark, edges):
    assert brown.scores(spark, empty(edges)).count() == 0
    assert substrings.deduplicated(spark, empty(edges)).count() == 0
    assert rules.judged(empty(edges)).count() == 0
    assert packing.packed(spark, empty(edges), *packing.public_ranks()).count() == 0


# --- quality -------------------------------------------------------------------------------

def test_quality_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = queries.op2_quality(spark, folder).filter("held_out").join(labels, "doc_id").collect()
    right = sum(r.predicted == r.quality for r in rows)
    assert len(rows) > 40 and right / len(rows) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_edges(spark, edges):
    labels = spark.createDataFrame([(4, 1), (5, None)], "doc_id long, quality int")
    model = quality.trained(spark, edges, labels, F.lit(True))
    scored = quality.scored(edges, model)
    assert scored.count() == len(EDGES) and scored.columns[:-1] == edges.columns
    rows = quality.scored(edges, quality.RuleModel(0.5, {"words > 2.0D AND digits <= 0.5D": -1.0}))
    assert {r.quality_score for r in rows.collect()} <= {1 / (1 + math.exp(-0.5)), 1 / (1 + math.exp(0.5))}
    assert quality.scored(empty(edges), model).count() == 0


# --- pipeline ------------------------------------------------------------------------------

def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        assert 0 < docs.count() <= before
        before = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {
        r.doc_id for r in docs.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, SMALL).count() == pieces.count()
