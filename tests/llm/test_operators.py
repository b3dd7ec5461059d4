"""Each operator against brute force on a small corpus with every awkward case."""

import base64
import hashlib
import math
import pickle
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quintet.llm import common, components, decontaminate, linededup, lmscore, media, mixing, neardup, sstable, tokencounts, tokenids, toxicity, warc, wordbpe

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
WORD, WIDE = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"), re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that clash with what operators add or use inside.
CLASH = ["id", "h", "n", "size", "copies", "rank", "items", "n_words", "spans", "kept", "cid", "label", "score", "predicted", "media", "n_bytes", "chunk", "key", "one"]
R = np.random.default_rng(5)
VOCABULARY = [f"w{i}é" if i % 7 == 0 else f"Word{i}" for i in range(400)]
LINE = "This is a license line that many of the documents share, Ünïcode too."
BENCH = [(i, " ".join(R.choice(VOCABULARY, 30))) for i in range(6)] + [(6, "only Four words here"), (7, ""), (8, None), (9, "only four WORDS, here!")]


def texts() -> list[tuple]:
    rows, base = [], [" ".join(R.choice(VOCABULARY, 60)) for _ in range(6)]
    for i in range(60):
        words = list(R.choice(VOCABULARY, int(R.integers(1, 120))))
        if i % 4 == 0:  # near copies, some of them just beyond the threshold
            words = base[i % 6].split()
            for _ in range(int(R.integers(0, 4))):
                words[int(R.integers(0, len(words)))] = "changed"
        if i % 9 == 0:
            words[3:3] = BENCH[i % 6][1].split()[5:24]
        text = " ".join(words)
        if i % 3 == 0:
            text = f"{text}\n  {LINE.upper()}\t\nshort\n\n{LINE}"
        rows.append((i, text))
    same = " ".join(R.choice(VOCABULARY, 40))
    rows += [(100 + i, same) for i in range(12)] + [(90, None), (91, ""), (92, " \n\t\n"), (93, "\n\n"), (94, "only four words here"), (95, "one two three"), (96, "one TWO three"), (97, "z" * 5000), (98, " ".join(VOCABULARY * 40)), (99, "Its an É́ <|endoftext|> Σ <|ENDOFTEXT|> a.b, c.")]
    return [(i, t, "en", None if i % 11 == 0 else "src0" if i % 3 else f"src{i % 5}", len(t or "")) for i, t in rows]


ROWS = texts()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3).persist()


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


@pytest.fixture(scope="module")
def odd(spark):
    """Rows that repeat, null ids and sources, and columns whose names clash."""
    rows = [(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (1, "other text of it", "en", None, 1), (None, "a b c d e f", None, None, None), (None, None, None, "s", None), (2, "", "en", "s", 0)]
    frame = spark.createDataFrame(rows, DOCS)
    return frame.select("*", *[F.lit("x").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


# 1


def contamination(text, window=13):
    windows = defaultdict(set)
    for i, t in BENCH:
        words = WORD.findall((t or "").translate(LOW))
        for k in range(max(1, len(words) - window + 1) if words else 0):
            windows[tuple(words[k : k + window])].add(str(i))
    words = WORD.findall((text or "").translate(LOW))
    hit, items = [False] * len(words), set()
    for n in {len(w) for w in windows}:
        for k in range(len(words) - n + 1):
            if of := windows.get(tuple(words[k : k + n])):
                items |= of
                hit[k : k + n] = [True] * n
    n = sum(hit)
    return len(words), n, sorted(items), n > 0 and 20 * n >= len(words), words, hit


def test_decontaminate(docs, benchmark):
    text = {r[0]: r[1] for r in ROWS}
    for most in (1 << 20, 200):  # one automaton, and several
        got = decontaminate.find(docs, benchmark, most_nodes=most).collect()
        assert len(got) == len(ROWS)
        for r in got:
            n, hits, items, bad, words, hit = contamination(text[r["doc_id"]])
            assert (r["n_words"], r["n_hit"], r["items"], r["n_items"], r["contaminated"]) == (n, hits, items, len(items), bad)
            covered = [w for s in r["spans"] for w in WORD.findall(text[r["doc_id"]][s["start"] : s["end"]].translate(LOW))]
            assert covered == [w for w, x in zip(words, hit, strict=True) if x]
    assert sum(contamination(t)[3] for t in text.values()) >= 4


def test_decontaminate_odd(odd, none, benchmark, spark):
    got = decontaminate.find(odd, benchmark)
    assert got.count() == 6 and "key" in got.columns
    assert decontaminate.find(none, benchmark).count() == 0
    assert decontaminate.find(odd, benchmark.filter("false")).agg(F.sum("n_hit")).first()[0] == 0
    named = spark.createDataFrame([(None, "a b c")], "item_id long, text string")
    assert rows_of(decontaminate.find(odd.filter("doc_id = 1"), named), "n_hit", "n_items") == [(0, 0), (3, 0), (3, 0)]


def test_pieces_find_every_window():
    r = random.Random(8)
    for trial in range(400):
        window, words = r.choice([1, 2, 3, 5, 13]), [f"v{i}" for i in range(r.choice([2, 3, 40]))]  # few words repeat and overlap
        items = [(str(i), [r.choice(words) for _ in range(r.randint(0, 3 * window + 2))]) for i in range(4)] + [(None, [words[0]] * window)]
        doc = [r.choice(words) for _ in range(20)]
        for _ in range(2):
            own, at = r.choice(items)[1], r.randint(0, 20)
            a = r.randint(0, len(own))
            doc[at:at] = own[a : a + r.randint(0, 2 * window)]
        hit, of = set(), set()
        for ident, own in items:
            n = min(window, len(own))
            for a in range(len(own) - n + 1) if n else ():
                for i in range(len(doc) - n + 1):
                    if doc[i : i + n] == own[a : a + n]:
                        hit.update(range(i, i + n))
                        of.add(ident)
        scan = decontaminate.Scanner([(i, " ".join(w).encode()) for i, w in items], window).scan([w.encode() for w in doc])
        assert {i for a, b, _ in scan for i in range(a, b)} == hit, trial
        assert {x[2] for x in scan} == of


# 2


def water(sizes, weights=(1, 2, 3), most=3):
    order = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, free, out = sum(sizes.values()), set(order), {}
    while free:
        level = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if level[s] > most * sizes[s]]
        if not full:
            out.update(level)
            break
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
            free.remove(s)
    return out


def test_mixing(docs):
    sizes, own, by = {r[0]: len(WIDE.findall(r[1] or "")) for r in ROWS}, defaultdict(int), {r[0]: r[3] for r in ROWS}
    for r in ROWS:
        own[r[3]] += sizes[r[0]]
    want = water(own)
    first = None
    for base in (1.0, 1.0, 0.5, 0.0):
        found = mixing.mix(docs, base=base).collect()
        taken = defaultdict(int)
        assert len(found) == len(ROWS)
        for r in found:
            assert r["size"] == sizes[r["id"]] and r["source_size"] == own[r["source"]] and 0 <= r["copies"] <= 3
            assert r["target"] == pytest.approx(want[r["source"]])
            taken[r["source"]] += r["copies"] * r["size"]
        for s, t in want.items():
            # a source's last word counts: no copies can undo a text that is longer than what is missing
            assert abs(taken[s] - t) <= max([15, *(z / 2 for i, z in sizes.items() if z > 1000 and by[i] == s)]), (base, s, taken[s], t)
        said = sorted((r["id"], r["copies"]) for r in found)
        if base == 1.0:
            assert first in (None, said)
            first = said


def test_mixing_tilts_documents(docs):
    """Production's multipliers and rates against bisection, source by source."""
    sizes, by = defaultdict(list), defaultdict(int)
    for r in ROWS:
        sizes[r[3]].append(len(WIDE.findall(r[1] or "")))
        by[r[3]] += sizes[r[3]][-1]
    want = water(by)
    rows = common.cut(mixing.sized(docs, "doc_id", "text", "source"))
    cells = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    goal = mixing.targets(cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")))
    got = {r["source"]: r["lam"] for r in mixing.duals(cells.filter("size > 0"), goal.filter("source_size > 0")).collect()}
    assert set(got) == {s for s in by if by[s]}
    for s, lam in got.items():
        z = np.array([x for x in sizes[s] if x], float)
        taken = lambda v: float((z * np.minimum(np.exp(np.minimum(v * z, 50)), 3)).sum())
        lo, hi = -60.0, 60.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if taken(mid) < want[s] else (lo, mid)
        assert taken(lam) == pytest.approx(want[s], rel=1e-6)
        assert np.minimum(np.exp(np.minimum(lam * z, 50)), 3) == pytest.approx(np.minimum(np.exp(np.minimum(hi * z, 50)), 3), rel=1e-4, abs=1e-9)
    # documents of a source differ in rate, and copies stay within one of it
    copies = defaultdict(list)
    for r in mixing.mix(docs).collect():
        if r["size"]:
            copies[r["source"], r["size"]].append(r["copies"])
            rate = min(3.0, math.exp(min(50, got[r["source"]] * r["size"])))
            assert abs(r["copies"] - rate) <= 1 + 1e-6 or r["size"] > 1000
    rates = defaultdict(set)
    for s, z in copies:
        rates[s].add(round(min(3.0, math.exp(min(50, got[s] * z))), 4))
    assert max(map(len, rates.values())) > 1


def test_many_sources(spark):
    r = np.random.default_rng(3)
    sizes = {f"host{i}": int(n) for i, n in enumerate(r.integers(1, 1000, 300))} | {None: 5, "": 10**6}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(7)).collect()}
    assert got == {s: pytest.approx(t) for s, t in water(sizes).items()}


def test_targets(spark):
    for sizes in ({"a": 100, "b": 1, "c": 5, "d": 1000}, {"a": 7}, {"a": 5, None: 100}, {"b": 0, "c": 10}, {"a": 1, "b": 1, "c": 1, "d": 5000, "e": 20}):
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(frame).collect()}
        want = water(sizes)
        assert got == {s: pytest.approx(want[s]) for s in sizes}, sizes


def test_mixing_large_cells(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BIN", 16)
    rows = [(i, "w " * 5, "en", "s" if i % 4 else "t", 10) for i in range(1000)]
    found = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    taken = defaultdict(int)
    for r in found:
        taken[r["source"]] += r["copies"] * 5
        target = r["target"]
    assert abs(taken["s"] + taken["t"] - 5000) <= 10 and abs(taken["t"] - target if found[-1]["source"] == "t" else 0) <= 5


def test_mixing_odd(odd, none, spark):
    found = mixing.mix(odd)
    assert found.count() == 6
    assert mixing.mix(none).count() == 0
    stage = mixing.stage(spark, odd, "")
    assert stage.columns == odd.columns
    copies = {(r["id"], r["h"]): r["n"] for r in found.groupBy("id", "h").agg(F.sum("copies").alias("n")).collect()}
    assert stage.count() == sum(copies.values())
    assert mixing.stage(spark, none, "").count() == 0


# 3


def kept_lines(rows, least=40, most=5):
    holders, key = defaultdict(set), lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                holders[key(x)].add(-1 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders[key(x)]) >= most and max(holders[key(x)]) != (-1 if i is None else i))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(docs):
    want = kept_lines([(r[0], r[1]) for r in ROWS])
    got = linededup.dedup(docs)
    assert rows_of(got, "doc_id", "n_lines", "n_dropped", "kept") == sorted(want, key=str)
    assert sum(w[2] for w in want) > 20
    for r in got.collect():
        assert r["kept_sha256"] == hashlib.sha256(r["kept"].encode()).hexdigest()


def test_line_dedup_odd(spark, odd, none):
    assert linededup.dedup(none).count() == 0
    assert linededup.dedup(odd).count() == 6
    long = "x" * 39
    for text, n in ((long, 0), (long + "é", 1)):  # code points, not bytes
        rows = [(i, text) for i in (None, 1, 1, 2, 3, 4)]
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        assert rows_of(linededup.dedup(frame), "doc_id", "n_lines", "n_dropped", "kept") == sorted(kept_lines(rows), key=str)
        assert linededup.dedup(frame).agg(F.sum("n_dropped")).first()[0] == 5 * n
    twice = spark.createDataFrame([(i, f"{LINE}\n{LINE}") for i in range(5)], "doc_id long, text string")
    assert rows_of(linededup.dedup(twice), "doc_id", "n_dropped") == [(0, 2), (1, 2), (2, 2), (3, 2), (4, 0)]


# 4


def shingle_set(text):
    words = WIDE.findall((text or "").translate(LOW))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def groups(rows, percent=75):
    sets, parent = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = defaultdict(lambda: None)
    for a, (i, _) in enumerate(rows):
        if i is not None and (least[find(a)] is None or i < least[find(a)]):
            least[find(a)] = i
    return [(i, len(sets[a]), least[find(a)] if sets[a] else i, i == (least[find(a)] if sets[a] else i)) for a, (i, _) in enumerate(rows)]


def test_near_duplicates(docs):
    want = sorted(groups([(r[0], r[1]) for r in ROWS]), key=str)
    assert rows_of(neardup.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept") == want
    assert sum(not w[3] for w in want) > 15
    # no star rounds: only the pair by pair way
    assert rows_of(neardup.near_duplicates(docs, star_rounds=0), "doc_id", "n_shingles", "component_id", "kept") == want


def test_near_duplicates_chain(spark):
    """A chain in which only neighbours link, under one common passage."""
    words = [f"v{i}" for i in range(400)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 120])) for i in range(30)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(groups(rows), key=str)


def test_near_duplicates_family(spark):
    """A large family around one text, in which some members are near others, some near none."""
    r = np.random.default_rng(4)
    base, rows = [f"b{i}" for i in range(100)], []
    for i in range(150):
        words = list(base)
        for _ in range(int(r.integers(0, 9))):
            words[int(r.integers(0, 100))] = f"x{r.integers(0, 10**9)}"
        rows.append((i, " ".join(words)))
    want = sorted(groups(rows), key=str)
    for rounds in (0, 1, 2):
        got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), star_rounds=rounds)
        assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == want


def test_near_duplicates_large_family(spark):
    """2,000 near copies of one text, many just below the threshold, against brute force."""
    r = np.random.default_rng(12)
    base = [f"w{i}" for i in range(70)]
    rows = [(0, " ".join(base))]
    for i in range(1, 2000):
        words = list(base)
        for at in r.choice(70, int(r.integers(0, 5)), replace=False):
            words[at] = f"x{r.integers(0, 3000)}"
        rows.append((i, " ".join(words)))
    sets = [frozenset(shingle_set(t)) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if (a := root(i)) != (b := root(j)) and 175 * len(sets[i] & sets[j]) >= 75 * (len(sets[i]) + len(sets[j])):
                parent[max(a, b)] = min(a, b)
    want = {i: root(i) for i in range(len(rows))}
    assert 20 < len(set(want.values())) < 1990
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_near_duplicates_odd(spark, odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    got = rows_of(neardup.near_duplicates(odd), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(groups(rows), key=str)
    assert neardup.near_duplicates(none).count() == 0
    stage = neardup.stage(spark, odd, "")
    assert stage.columns == odd.columns
    # what goes is the copy under a null id; another text of an id that stays or goes is judged by itself
    assert rows_of(stage, "doc_id", "text") == sorted([r for r in rows if r != (None, "a b c d e f")], key=str)
    more = spark.createDataFrame([(1, "p q r s t u v"), (5, "p q r s t u v"), (5, "its other text is alone here"), (None, "alone as well, without an id")], "doc_id long, text string")
    assert rows_of(neardup.stage(spark, more, ""), "doc_id", "text") == sorted([(1, "p q r s t u v"), (5, "its other text is alone here"), (None, "alone as well, without an id")], key=str)


def test_components(spark):
    r = np.random.default_rng(2)
    for n, m in ((50, 30), (200, 400), (40, 39)):
        links = [(i, i + 1) for i in range(m)] if m == n - 1 else [tuple(int(x) for x in r.integers(0, n, 2)) for _ in range(m)]
        parent = list(range(n))
        for a, b in links * n:
            low = min(parent[a], parent[b])
            parent[a] = parent[b] = low
        for at_once in (1 << 20, max(1, len(links) // 5)):  # one task, and several
            found = components.components(spark.createDataFrame(links, "u long, v long").repartition(6), common.Scratch(spark), at_once=at_once).collect()
            got = dict(tuple(x) for x in found)
            assert all(got[i] == parent[i] for i in got) and len(found) == len(got)
            assert set(got) == {x for a, b in links if a != b for x in (a, b)}


# 5


def test_warc(spark, tmp_path):
    r = np.random.default_rng(1)
    html = ["", "same", "x" * 100_000, "\x1f\x8b\x08 not gzip", base64.b64encode(r.bytes(3000)).decode()]
    pages = [(i, f"http://a/{i}\n b", html[i % 5] if i % 7 else f"<p>{i}é</p>") for i in range(60)] + [(60, None, None), (59, "again", html[59 % 5]), (None, "n", "same"), (None, "n", "alone")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    for least in (0, 5):
        archives = warc.write(frame, f"file://{tmp_path}/warc{least}", min_revisit_bytes=least)
        same = defaultdict(list)
        for i, _, t in pages:
            same[t or ""].append(i)
        want = []
        for i, _, t in pages:
            raw = (t or "").encode()
            last = max((x for x in same[t or ""] if x is not None), default=None)
            again = len(raw) >= least and i != last
            want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", last if again else None))
        for split in (1, 700, 1 << 20):  # every byte its own range, some, one
            if split == 1 and archives.agg(F.sum("bytes")).first()[0] > 200_000:
                continue
            got = warc.read(archives, split_bytes=split)
            unknown = got.withColumn("payload_bytes", F.when(F.col("record_type") == "response", F.col("payload_bytes")))
            assert rows_of(warc.resolved(unknown), "page_id", "payload_bytes") == sorted(((w[0], w[1]) for w in want), key=str)
            assert rows_of(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=str), split
    import gzip
    import pathlib

    assert all(gzip.decompress(p.read_bytes()).startswith(b"WARC/1.1") for p in pathlib.Path(f"{tmp_path}/warc0").glob("*.gz"))
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(none, f"file://{tmp_path}/none")).count() == 0


def record(kind, block, content=None, **more):
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:{kind}>", "Content-Length": len(block)} | ({"Content-Type": content} if content else {}) | more
    return b"WARC/1.0\r\n" + b"".join(f"{k.replace('_', '-')}: {v}\r\n".encode() for k, v in head.items()) + b"\r\n" + block + b"\r\n\r\n"


def test_warc_of_other_writers(spark, tmp_path):
    import gzip

    http = "application/http; msgtype=response"
    blocks = [
        ("warcinfo", b"software: x\r\nformat: WARC File Format 1.0\r\n\r\nmore", "application/warc-fields"),
        ("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "application/http; msgtype=request"),
        ("response", b"HTTP/1.1 200 OK\r\n\r\n<p>\r\n\r\n</p>" + bytes(700_000), http),
        ("response", b"HTTP/1.1 204 No Content\r\nno blank line", http),
        ("metadata", b"", None),
        ("conversion", b"first paragraph\r\n\r\nsecond", "text/plain"),
        ("revisit", b"HTTP/1.1 200 OK\r\n\r\n", http),
        ("conversion", b"last", "text/plain"),
    ]
    payload = lambda block, kind: block.partition(b"\r\n\r\n")[2] if (kind or "").startswith("application/http") else block
    want = [(k, None, None) if k == "revisit" else (k, len(payload(b, c)), base64.b32encode(hashlib.sha1(payload(b, c)).digest()).decode()) for k, b, c in blocks]
    raws = [record(*x) for x in blocks]
    files = {"each": b"".join(map(gzip.compress, raws)), "one": gzip.compress(b"".join(raws)), "two": gzip.compress(b"".join(raws[:3])) + gzip.compress(b"".join(raws[3:])) + bytes(100)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
        listed = spark.createDataFrame([(f"file://{tmp_path}/{name}", len(data))], warc.MANIFEST)
        for split in (97, 4 << 20):
            got = warc.read(listed, split_bytes=split).orderBy("offset").collect()
            assert sorted(map(str, want)) == sorted(str((r["record_type"], r["payload_bytes"], r["payload_digest"])) for r in got), (name, split)
    for name, data in {"cut": files["each"][:-9], "flipped": files["one"][:300] + b"\xff\x00\xff" + files["one"][303:], "junk": files["each"] + b"junk"}.items():
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match="damaged|no member"):
            warc.read(spark.createDataFrame([(f"file://{tmp_path}/{name}", len(data))], warc.MANIFEST)).collect()


def test_warc_long_urls(spark, tmp_path):
    long = "http://example.org/" + "é\x01 a" * 500_000
    rows = [(1, "http://example.org/", "<p>one</p>"), (2, long, "<p>two</p>"), (3, long + "b", "<p>two</p>"), (4, None, None)]
    archives = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/long")
    for split in (1000, 4 << 20):
        got = {r["page_id"]: r for r in warc.read(archives, split_bytes=split).collect()}
        assert sorted(got) == [1, 2, 3, 4], split
        assert got[2]["refers_to"] == 3 and got[2]["record_type"] == "revisit" and got[2]["payload_bytes"] == 10
        assert got[3]["url"] == (long + "b").replace("\x01", "%01").replace(" ", "%20")


# 6


def test_scores(spark, docs):
    rows = [(r[0], r[1]) for r in ROWS]
    words = {i: WIDE.findall((t or "").translate(LOW)) for i, t in rows}
    for order in (1, 2, 3):
        counts = [Counter() for _ in range(order + 1)]
        own = {i: [Counter() for _ in range(order + 1)] for i in words}
        for i, w in words.items():
            for n in range(1, order + 1):
                own[i][n].update(zip(*[w[k:] for k in range(n)], strict=False))
                counts[n].update(own[i][n])
        total = sum(map(len, words.values()))

        def log_score(i, w, k, n, counts=counts, own=own, total=total):
            gram = tuple(w[k - n + 1 : k + 1])
            seen = counts[n][gram] - own[i][n][gram]
            if n == 1:
                return math.log(max(seen, 0.5) / max(1, total - len(w))), seen > 0
            if seen > 0:
                return math.log(seen / (counts[n - 1][gram[:-1]] - own[i][n - 1][gram[:-1]])), True
            return math.log(0.4) + log_score(i, w, k, n - 1)[0], False

        got = {r["id"]: r for r in lmscore.score(docs, order=order).collect()}
        assert len(got) == len(rows)
        for i, w in words.items():
            parts = [log_score(i, w, k, min(order, k + 1)) for k in range(len(w))]
            assert got[i]["n_words"] == len(w) and got[i]["log_prob"] == pytest.approx(sum(p[0] for p in parts), abs=1e-6)
            assert got[i]["n_seen"] == sum(p[1] for p in parts)


def test_scores_over_many_chunks(spark, docs, monkeypatch):
    whole = rows_of(lmscore.score(docs), "id", "n_words", F.round("log_prob", 8), "n_seen")
    monkeypatch.setattr(lmscore, "CHUNK_CHARS", 3000)
    monkeypatch.setattr(lmscore, "BUCKET_CHARS", 5000)
    assert rows_of(lmscore.score(docs), "id", "n_words", F.round("log_prob", 8), "n_seen") == whole


def test_query_counts_trigrams(spark, tmp_path):
    from quintet.llm import queries

    rows = [(0, "a b c"), (1, "A b\nc"), (2, "x b d"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_lm_score"](spark, str(tmp_path)).collect()}
    # c follows "a b" in all other documents, but b alone in half of them
    assert got[0]["log_prob"] == got[1]["log_prob"] == round(math.log(1 / 6), 6) and got[0]["n_seen"] == 3
    assert got[3]["n_words"] == 0 and got[3]["score"] is None


def test_scores_of_documents_packed_in_parts(spark, docs, monkeypatch):
    whole = rows_of(lmscore.score(docs, order=3), "id", "n_words", F.round("log_prob", 8), "n_seen")
    monkeypatch.setattr(lmscore, "PACK_BYTES", 1)
    monkeypatch.setattr(lmscore, "CHUNK_CHARS", 3000)
    assert rows_of(lmscore.score(docs.repartition(20), order=3), "id", "n_words", F.round("log_prob", 8), "n_seen") == whole


def test_scores_odd(odd, none):
    assert lmscore.score(odd).count() == 6
    assert lmscore.score(none).count() == 0


# 7


def toxic_rows(n, seed):
    r, out = np.random.default_rng(seed), []
    for i in range(n):
        words = [f"{r.choice(list('abcdefgh'))}{r.choice(['ari', 'on', 'ub', 'eth'])}{r.integers(0, 30)}x" for _ in range(int(r.integers(5, 150)))]
        bad = i % 4 == 0
        for _ in range(4 * bad):
            words.insert(int(r.integers(0, len(words) + 1)), f"nast{r.choice(list('abcdefghij'))}{r.integers(0, 50)}")
        out.append((i, " ".join(words), int(bad)))
    return out


def test_toxicity(spark, none):
    made = toxic_rows(700, 3)
    frame = spark.createDataFrame([(i, t) for i, t, _ in made] + [(None, "nasta1 nastb2"), (9000, None), (9001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, x) for i, _, x in made] + [(0, 0, 1), (None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(frame.select("*", F.lit(1).alias("score"), F.lit("z").alias("label")), labels).collect()}
    assert len(got) == 703 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None)
    assert got[9000]["score"] == got[9001]["score"] == 0
    out = [(got[i]["predicted"], x) for i, _, x in made if got[i]["held_out"]]
    right = sum(p and x for p, x in out)
    assert right / max(1, sum(p for p, _ in out)) > 0.9 and right / sum(x for _, x in out) > 0.8
    # a label that is held out changes nothing
    held = [i for i in got if i is not None and i < 700 and got[i]["held_out"]]
    other = labels.withColumn("toxic", F.when(F.col("doc_id").isin(held), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r["doc_id"]: r["score"] for r in toxicity.score(frame, other).collect()} == {i: r["score"] for i, r in got.items()}
    assert toxicity.score(none, labels).count() == 0
    assert toxicity.score(frame, labels.filter("false")).agg(F.max("score")).first()[0] < 1e-9


def test_rare_classes_are_learned_from():
    # each class is dealt by itself, however few its rows are
    for n in (1, 2, 3, 4, 9):
        labels = np.array([0] * 30 + [1] * n, np.float32)
        parts = toxicity.dealt(labels)
        assert all(set(labels[p].tolist()) == {0, 1} for p in parts)
        assert set(np.concatenate(parts).tolist()) == set(range(30 + n))


def test_sample_is_bounded_by_rows_and_bytes(spark, monkeypatch):
    rows = [(i, "clean words here " * (i % 7 + 1) if i % 2 else f"vileword{i % 3} hatred " * 4) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(300)], "doc_id long, toxic int")
    some = toxicity.sample(docs, labels, 20).collect()
    assert len(some) == 40 and sum(r["toxic"] for r in some) == 20
    # one long row first fills the bound; the model then knows one class only
    model = pickle.loads(toxicity.fitted(docs, labels, 20, 1))
    assert toxicity.score_texts(model, [b"vileword1 hatred"])[0] < 1e-9


def test_gradients(monkeypatch):
    monkeypatch.setattr(toxicity, "F32", np.float64)
    words = toxicity.Words([b"the cat sat on the mat bad bad " * 3, b"a clean text here", b"one two three four five six seven " * 9])
    rows, text = toxicity.windows(words)
    model, r = toxicity.Model(), np.random.default_rng(0)
    model.p = {k: v.astype(float) for k, v in model.p.items()}
    odds = (r.normal(size=toxicity.BUCKETS), r.normal(size=toxicity.BUCKETS))
    y = np.array([1.0, 0, 1])[text]

    def loss():
        gates = model.projected(toxicity.inputs(words, odds, model.p))
        x = model.pooled(model.states(gates, rows), rows < len(words.word))[3]
        return float((np.log1p(np.exp(x)) - y * x).mean())

    grad = model.gradients(words, toxicity.inputs(words, odds, model.p), rows, y, np.ones(len(y)))
    for k, v in model.p.items():
        for i in [tuple(i) for i in np.argwhere(np.abs(grad[k]) > 1e-7)][:30:6]:
            old = v[i]
            v[i] = old + 1e-5
            up = loss()
            v[i] = old - 1e-5
            down = loss()
            v[i] = old
            assert grad[k][i] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6), k


def test_windows_cover_every_word():
    for n in (0, 1, 16, 17, 32, 33, 48, 49, 200):
        rows, text = toxicity.windows(toxicity.Words([" ".join(f"w{i}" for i in range(n)).encode(), b"x"]))
        seen = {int(x) for row in rows[text == 0] for x in row if x < n + 1}
        assert len(seen) == n


# 8


def files(media_bytes):
    while media_bytes:
        n = 8 + int.from_bytes(media_bytes[4:8], "little")
        yield media_bytes[:n]
        media_bytes = media_bytes[n:]


def naive(raw):
    """A stored file's bytes by the plain decoder, pixel by pixel."""
    from quintet.llm import webp

    webp.QUICK = False
    try:
        return (webp.decode(raw) >> np.uint32(8)).astype(np.uint8).tobytes()
    finally:
        webp.QUICK = True


def test_media(docs, odd, none):
    got = {r["doc_id"]: r for r in media.read(media.store(docs)).collect()}
    stored = {r["doc_id"]: r for r in media.store(docs).collect()}
    for i, t, *_ in ROWS:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored[i]["media"]), hashlib.sha256(stored[i]["media"]).hexdigest())
        share = [n / len(payload) for n in Counter(payload).values()]
        bits = 0 - sum(p * math.log2(p) for p in share)
        size, mean, distinct, entropy = r["feature"].split(";")
        assert (size, distinct) == (f"192x{len(payload) // 192}", f"distinct={len(share)}")
        assert float(mean.removeprefix("mean=")) == pytest.approx(sum(payload) / len(payload), abs=1e-4)
        assert float(entropy.removeprefix("entropy=")) == pytest.approx(bits, abs=1e-4)
        assert b"".join(naive(x) for x in files(stored[i]["media"])) == payload
    assert got[100]["media_sha256"] == got[101]["media_sha256"] and got[100]["feature"] == got[101]["feature"]
    assert media.read(media.store(odd)).count() == 6 and media.read(media.store(none)).count() == 0
    long = bytes(np.random.default_rng(0).integers(0, 256, 192 * 16384 + 192 * 5, dtype=np.uint8))
    assert media.samples(media.images(long, 192)).tobytes() == long


# 9


def test_shards(tmp_path):
    import pyarrow as pa

    values = [(None, b"\1\2"), (-5, b""), (3, b"\7\0"), (3, b"\1\0")] + [(i, i.to_bytes(2, "little") * (i % 50)) for i in range(10, 3000, 3)]
    with pa.OSFile(str(tmp_path / "a.sst"), "wb") as out:
        w = sstable.Writer(out, 2, block_bytes=2000)
        for v in values:
            w.add(*v)
        w.finish()
    with pa.OSFile(str(tmp_path / "a.sst")) as f:
        reader = sstable.Reader(f)
        assert list(reader.scan()) == values and len(reader.places) > 5
        by_id = defaultdict(list)
        for i, v in values:
            by_id[i].append(v)
        for i in [None, *range(-10, 3010)]:
            assert reader.lookup(i) == by_id.get(i, [])
    w = sstable.Writer(open(tmp_path / "b.sst", "wb"), 2)  # noqa: SIM115
    w.add(5, b"")
    with pytest.raises(ValueError, match="ascend"):
        w.add(4, b"")


def ids_of(rows):
    library = wordbpe.load(tokenids.vocabulary()).library
    start, out = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_ids(spark, docs, odd, none):
    got = rows_of(tokenids.stage(spark, docs, ""), "doc_id", "start", "n_tokens", "ids_crc32")
    assert got == sorted(ids_of([(r[0], r[1]) for r in ROWS]), key=str)
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert rows_of(tokenids.stage(spark, odd, ""), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(ids_of(rows), key=str)
    assert tokenids.stage(spark, none, "").count() == 0


def fuzzed(seed, n):
    """Texts over all classes of characters, capitals and marks."""
    r = random.Random(seed)
    by = {}
    for c in (c for c in range(0x20, 0x2FFFF) if not 0xD800 <= c < 0xE000):
        by.setdefault(unicodedata.category(chr(c)), []).append(chr(c))
    classes, ends = list(by.values()), ["", ".", ",", "'s", "..", ".,"]
    latin = lambda: chr(r.choice([r.randint(0x41, 0x5A), r.randint(0x61, 0x7A), r.randint(0xC0, 0x24F)]))
    any_of = lambda: r.choice(r.choice(classes)) if r.random() < 0.6 else r.choice("aZé0.,'")
    word = lambda: "".join((latin if r.random() < 0.6 else any_of)() for _ in range(r.randint(1, 7))) + r.choice(ends)
    return [r.choice([" ", "\n", "\t", "  "]).join(word() for _ in range(r.randint(1, 6))) for _ in range(n)]


def test_words_encode_as_the_library_does():
    bpe = wordbpe.WordBpe(tokenids.vocabulary(), 1 << 20)  # a store so small that generations pass
    found = [*fuzzed(3, 50_000), "ABDİ. İ, İstanbul. ǅ. ŉ, Y\u030Aj W\u030A. H\u0331,"]
    for at in range(0, len(found), 2000):
        part = found[at : at + 2000]
        want = [bpe.pack(e.ids) for e in bpe.library.encode_batch_fast(part, add_special_tokens=False)]
        assert bpe.encode([t.encode() for t in part]) == want


def test_word_store_is_bounded():
    bpe = wordbpe.WordBpe(tokenids.vocabulary(), 1 << 18)
    for k in range(20):
        words = [f"{'abcdefghij'[i % 10]}{'x' * (i % 60)}q{k}z{i}" for i in range(1000)]
        text = " ".join(words)
        assert bpe.encode([text.encode()]) == bpe.whole([text])
        size = sum(len(w) + wordbpe.ENTRY for w in (*bpe.known, *bpe.known.older))
        assert size <= (1 << 18) + 1000 * (wordbpe.ENTRY + 80) * 2 and max(map(len, (*bpe.known, *bpe.known.older)), default=0) <= wordbpe.LONG


def test_words_encode_as_whole_texts():
    bpe = wordbpe.load(tokenids.vocabulary())
    cases = ["It's don't I'LL we'RE 'S ''s x''s a'sb", "café CAFÉ É́ ﬁ ſ K Å ΑΣ ΟΔΟΣ. σς ß ẞ İ i̇ ǅ", "<|endoftext|> <|ENDOFTEXT|>a <|startoftext|>x. <| |>", "a\x0bb\x0cc\x1cd\x85e f​g﻿i", "日本語。漢字, x。 1234 ½ Ⅷ a1.b2, ...x, .,.,", "a. b, .. ,, . , a.. é. é, 1. _. …. ½. ²."]
    for case in cases:
        for text in (case, case.lower(), case.upper()):
            assert bpe.encode([text.encode()]) == bpe.whole([text])
    small = wordbpe.WordBpe(tokenids.vocabulary(), most_bytes=20_000)  # a store that is emptied again and again
    texts = [r[1].encode() for r in ROWS if r[1]]
    assert [small.encode([t])[0] for t in texts] == small.whole([t.decode() for t in texts])


# 10


def test_long_runs_encode_as_pieces(monkeypatch):
    bpe = tokencounts.load(tokencounts.vocabulary())
    # the library itself takes shorter runs, so the cut is held against it with a low limit
    r = random.Random(4)
    texts = ["".join(r.choice(["a", "b1", ".", "é", "'s", " " * r.randint(1, 30), "\n" * r.randint(1, 30), "\u3000\x85", " \n "]) for _ in range(40)) for _ in range(400)]
    texts += [" " * 50, "\n" * 50 + "x", "x" + " " * 50, " " * 50 + "\n"]
    monkeypatch.setattr(tokencounts, "RUN", 5)
    for text in texts:
        assert bpe.ids(text) == bpe.encode.encode_ordinary(text)
    monkeypatch.undo()
    for text in (" " * 2_000_000, "a" + "\n" * 2_000_000 + "b", "a" * 2_000_000, "." * 2_000_000, "\u3000" * 1_200_000 + "x"):
        assert bpe.spans(text)[-1] == len(text.encode())


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_token_counts(docs, odd, none, rule):
    bpe = tokencounts.load(tokencounts.vocabulary())

    def ends(raw):  # sections of 7 bytes, so that tokens cross
        return np.append(np.arange(7, max(len(raw), 1), 7), len(raw)) if raw else np.array([0])

    got = {r["doc_id"]: r for r in tokencounts.count(docs, tokenizer=tokencounts.vocabulary(), rule=rule, section_ends=ends).collect()}
    for i, t, *_ in ROWS:
        raw, at = (t or "").encode(), 0
        counts, crossing = [0.0] * len(ends(raw)), 0
        for token in bpe.encode.encode_ordinary(t or ""):
            n = len(bpe.encode.decode_single_token_bytes(token))
            share = Counter((at + k) // 7 for k in range(n))
            crossing += len(share) > 1
            if rule == "start":
                counts[at // 7] += 1
            elif rule == "majority":
                counts[max(share, key=lambda s: (share[s], -s))] += 1
            else:
                for s, k in share.items():
                    counts[s] += k / n
            at += n
        assert at == len(raw)
        assert got[i]["n_crossing"] == crossing and got[i]["section_tokens"] == pytest.approx(counts)
    lines = tokencounts.count(docs, tokenizer=tokencounts.vocabulary())
    assert all(r["n_sections"] == (r["text"] or "").count("\n") + 1 and sum(r["section_tokens"]) == pytest.approx(r["n_tokens"]) for r in lines.collect())
    assert tokencounts.count(odd, tokenizer=tokencounts.vocabulary()).count() == 6
    assert tokencounts.count(none, tokenizer=tokencounts.vocabulary()).count() == 0


# all


def test_token_counts_of_fields(spark):
    rows = [(1, "A title", "Body text, with a\nbreak.", None), (2, None, None, None), (3, "é" * 40, "", "x  "), (4, "\n\n", "  \n", "tail")]
    frame = spark.createDataFrame(rows, "doc_id long, title string, body string, n_tokens string")
    bpe = tokencounts.load(tokencounts.vocabulary())
    for rule in tokencounts.RULES:
        for r in tokencounts.count_fields(frame, ["title", "body", "n_tokens"], tokenizer=tokencounts.vocabulary(), rule=rule).collect():
            parts = [x or "" for x in rows[r["doc_id"] - 1][1:]]
            text = "\n".join(parts)
            owner = [k for k, p in enumerate(parts) for _ in range(len(p.encode()) + (k < 2))]
            counts, crossing, at = [0.0] * 3, 0, 0
            for token in bpe.encode.encode_ordinary(text):
                n = int(bpe.lengths[token])
                of = Counter(owner[at : at + n])
                crossing += len(of) > 1
                if rule == "split":
                    for k, v in of.items():
                        counts[k] += v / n
                else:
                    counts[owner[at] if rule == "start" else min(of, key=lambda k: (-of[k], k))] += 1
                at += n
            assert (r["n_sections"], r["n_crossing"]) == (3, crossing) and list(r["section_tokens"]) == pytest.approx(counts)
    text = "aé漢\U0001f600b"
    ends = bpe.spans(text)
    assert tokencounts.characters(text, ends).tolist() == [len(text.encode()[:e].decode("utf-8", "ignore")) for e in ends]


def test_slices_lose_nothing(docs):
    batch = docs.select("doc_id", "text").toArrow().to_batches()
    for most in (1, 100, 1 << 30):
        assert [i for b in common.by_bytes(batch, "text", most) for i in b.column("doc_id").to_pylist()] == [i for b in batch for i in b.column("doc_id").to_pylist()]
