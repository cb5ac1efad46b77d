"""WARC round trips and main text of pages."""

import gzip
import hashlib
import math
import random
import re
import time
import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from pixelframe.llm import sitetree, warc
from pixelframe.session import ensure_checkpoint_dir

INSIDE = "a WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\n tail"
PAGES = [
    (1, "u", INSIDE), (2, "u\r\nContent-Length: 1", INSIDE), (3, None, None), (4, "u", ""), (4, "u", ""), (None, "x", "zz"), (None, "x", ""),
    (5, "u", "WARC/1.1\r\n" * 3), (6, "u", "é" * 70000), (7, "v", "WARC/1.1\r\nContent-Length: 500000\r\n\r\nx"), (8, "w", "\r\n\r\n"),
]


def round_trip(spark, pages):
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    warc.write_archives(pages, path)
    return warc.read_archives(spark, path)


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*r, "clash") for r in PAGES], "page_id long, url string, html string, payload string")
    for parts in (1, 4):
        rows = round_trip(spark, pages.withColumn("salt", F.lit(1)).coalesce(parts)).collect()
        best = {}
        for p, _, h in PAGES:
            best[h or ""] = max((x for x in (best.get(h or ""), p) if x is not None), default=None)
        want = sorted(
            (str(p), len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), *(("response", None) if best[h or ""] == p else ("revisit", best[h or ""])))
            for p, _, h in PAGES
        )
        got = sorted((str(r.page), r.length, r.sha1, r.kind, r.refers) for r in rows)
        assert got == want and all(r.sound for r in rows)


def test_warc_empty(spark):
    assert round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_chain_skips_a_long_row_of_false_records(spark):
    """Every payload holds records of its own, so the chain jumps over as many runs as there are pages."""
    pages = spark.range(60).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit(INSIDE), F.col("id")).alias("html"))
    rows = round_trip(spark, pages.coalesce(1)).collect()
    assert sorted(r.page for r in rows) == list(range(60)) and all(r.sound for r in rows)


def test_false_records_of_great_length_take_linear_time():
    took = []
    for n in (1000, 8000):
        false = b"WARC-Type: response\r\nContent-Length: 900000000\r\n\r\nx\r\n\r\n"
        inside = b"HTTP/1.1 200 OK\r\n\r\n" + b"".join(b"WARC/1.1\r\n" + false for _ in range(n))
        rows = (b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(inside) + inside + b"\r\n\r\n").split(b"WARC/1.1\r\n")
        start = time.perf_counter()
        batch = pa.record_batch([pa.array(["f"] * len(rows)), pa.array(rows, pa.binary())], names=["file", "value"])
        found = [r for b in warc.candidates([batch]) for r in b.to_pylist()]
        took.append(time.perf_counter() - start)
        assert len(found) == n + 2  # with the mark at the end
    assert took[1] < 24 * max(took[0], 0.02)


def test_damage_is_told(spark, tmp_path):
    folder = str(tmp_path)
    pages = spark.range(20).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<p>page "), "id").alias("html"))
    whole = b"".join((r.value + warc.END).encode() for r in warc.records(pages).orderBy("value").collect())
    starts = [m.start() for m in re.finditer(b"WARC/1.1\r\n", whole)]
    files = {
        "whole": whole,
        "altered": whole.replace(b"<p>page 7", b"<p>Page 7"),
        "cut": whole[:-9],  # inside the last payload
        "torn": whole[:starts[5] - 4] + whole[starts[5]:],  # a blank line is missing
        "noise": b"junk" + whole,
        "junk": b"no archive at all",
    }
    for name, data in files.items():
        with gzip.open(f"{folder}/{name}.txt.gz", "wb") as out:
            out.write(data)
    name = F.regexp_extract("file", r"(\w+)\.txt", 1)
    told = {r.name: (r.at, r.lost) for r in warc.damage(spark, folder).withColumn("name", name).collect()}
    assert told == {
        "cut": (len(whole), -9), "torn": (starts[5], len(whole) - 4 - starts[5]),
        "noise": (0, len(whole) + 4), "junk": (0, len(files["junk"])),
    }
    read = warc.read_archives(spark, folder).withColumn("name", name)
    got = {r.name: (r["count"], r.bad) for r in read.groupBy("name").agg(F.count("*").alias("count"), F.count_if(~F.col("sound")).alias("bad")).collect()}
    assert got == {"whole": (20, 0), "altered": (20, 1), "cut": (20, 1), "torn": (5, 0)}


def test_main_text():
    text = sitetree.main_text
    assert text("<body><nav>m</nav><article><h1>A &amp; B</h1><p>x<b>y</b> z<br>q\n\t r<p>u</article><footer>f</footer>") == "A & B xy z q r u"
    assert text("<div>a<p>b</div>c<div class='page-sidebar'>d</div><div id=cookieBanner>e</div> 2 < 3 & 4") == "a b c 2 < 3 & 4"
    assert text("<ul><li>1<li>2</ul><table><tr><td>q<td>w<tr><td>e</table><!-- z --><script>'<p>'</script>t<textarea>no</textarea>") == "1 2 q w e t"
    assert text("<article><p>yes</p><section class=comments><article>no</article></section><form>no</form></article> no") == "yes"
    assert text(None) == text("") == text("<p></p>") == text("<!-- open") == ""
    assert text("<a href='unclosed>x</a> <p>y") != "" and text("a &am b &#233; &nosuch;") == "a &am b é &nosuch;"


def test_hints_spare_what_holds_the_page():
    text = sitetree.main_text
    assert text("<div class='layout has-sidebar'><article><p>all of it</p></article><div class=sidebar>no</div></div>") == "all of it"
    assert text("<div id=main-nav-wrapper><p>a long story without landmarks</p></div><div class=nav>no</div>") == "a long story without landmarks"
    assert text("<article><p>x</p><div class=related>much longer than the story itself</div></article>") == "x"
    assert text("<div class=comments><article>short</article></div><article>the story is longer</article>") == "the story is longer"
    assert text("<p>a story <span class=ad>buy</span> goes on</p>") == "a story goes on"


def test_unclosed_markup_takes_linear_time():
    took = []
    for n in (4000, 32000):
        start = time.perf_counter()
        assert sitetree.main_text("<div>a" * n + "</p>" * n) == " ".join("a" * n)
        took.append(time.perf_counter() - start)
    assert took[1] < 24 * max(took[0], 0.02)


def test_low_branches_go_from_articles_unless_they_are_the_content(spark):
    page = lambda i, said: f"<body><article><h1>Story {i}</h1><p>{said}</p><div class=tail>Tell your friends</div></article></body>"
    rows = [(i, f"http://h.example/{i}", page(i, f"Words {i * i} and {i}.")) for i in range(30)]
    rows += [(100 + i, "http://copies.example/", page(1, "Always the same story.")) for i in range(30)]
    got = {r.page_id: (r.text, r.n_low) for r in sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == (f"Story {i} Words {i * i} and {i}.", 1) for i in range(30))
    assert all(got[100 + i] == ("Story 1 Always the same story. Tell your friends", 0) for i in range(30))


def noise_by_hand(pages):
    """Low branches of one host's pages, straight from the definitions."""
    seen, layouts, texts, above = Counter(), {}, {}, {}
    for page in pages:
        done, elements, _ = sitetree.blocks(page)
        for path in {e.path for e in elements} | {""}:
            seen[path] += 1
        kinds = {}
        for e in elements:
            above[e.path] = e.parent.path
            kinds.setdefault(e.path, set()).add(",".join(e.kids))
        for path, k in kinds.items():
            layouts.setdefault(path, Counter())["|".join(sorted(k))] += 1
        for path, said in {(e.path, said) for e, said in done}:
            texts.setdefault(path, Counter())[said] += 1
    entropy = lambda c: -sum(n / sum(c.values()) * math.log(n / sum(c.values())) for n in c.values())
    most = lambda path: math.log(seen[path]) if seen[path] > 1 else 1.0

    def judge(path):
        kids = [p for p in above if above[p] == path and p != path]
        below = [(seen[k], *judge(k)) for k in kids]
        content = None
        if path in texts:
            # What is said on n pages weighs its share of all that is said there, against as many pages as have the node.
            c = texts[path]
            content = 1 - sum(n * math.log(n) for n in c.values()) / sum(c.values()) / most(path)
        layout = entropy(layouts[path]) / most(path) if seen[path] > 1 else 1.0
        parts = [(n, w) for n, w, _ in below] + ([] if content is None else [(seen[path], content)])
        inner = sum(n * w for n, w in parts) / sum(n for n, _ in parts) if parts else layout
        share = sitetree.DECAY ** len(kids)
        worth = (1 - share) * layout + share * inner if kids else inner
        low = worth < sitetree.LOW and all(x for _, _, x in below) and (content is None or content < sitetree.LOW)
        return worth, low and seen[path] >= sitetree.LEAST_PAGES

    return {sitetree.path_hash(p) for p in above if judge(p)[1]}


def test_tree_equals_definitions(spark):
    rng = random.Random(6)
    words = lambda n: " ".join(rng.choice("red green blue one two three".split()) + str(rng.randrange(50)) for _ in range(n))
    pages = [
        f"<body><div class=top><b>Site</b> home<ul>{'<li>x' * rng.choice([2, 2, 2, 3])}</ul></div><div class=mid><h2>{rng.choice(['News', 'News', 'Views'])}</h2>"
        f"{''.join(f'<p>{words(5)}</p>' for _ in range(rng.randrange(1, 4)))}<div class=same>{rng.choice(['a', 'a', 'a', 'a', 'b'])}</div></div><p class=end>bye</p></body>"
        for _ in range(40)
    ]
    rows = spark.createDataFrame([("h", p) for p in pages], "host string, html string").repartition(5)
    got = {x for r in sitetree.site_noise(rows).collect() for x in r.noise}
    assert got == noise_by_hand(pages) and got


def test_branches_that_say_the_same_everywhere_go(spark):
    page = lambda i: f"<body><div class=top>Best site ever</div><div class=body><p>Story {i} of many.</p><p>{i * i} words</p></div><div class=end>All rights</div></body>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(30)] + [(100, "http://other.example/", page(100)), (101, None, None), (102, "odd", "")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.text, r.n_chars) for r in sitetree.extract(pages).collect()}
    assert all(got[i][0] == f"Story {i} of many. {i * i} words" for i in range(30))
    assert got[100][0] == "Best site ever Story 100 of many. 10000 words All rights"  # one page tells nothing of its host
    assert got[101] == got[102] == ("", 0)
    assert sitetree.extract(pages.limit(0)).count() == 0


def test_a_hot_host_is_dealt_over_parts(spark, monkeypatch):
    """Parts of one page: every page meets its host's low branches whatever part it falls in; classes may hold slashes."""
    page = lambda i: f"<body><div class='w-1/2 top'>Best site ever</div><div class=body><p>Story {i} of many.</p></div></body>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(40)] + [(7, "http://h.example/7", page(7))] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = sorted(map(tuple, sitetree.extract(pages).collect()))
    assert {r[4] for r in whole} == {1} and len(whole) == 43
    monkeypatch.setattr(sitetree, "PART_PAGES", 1)
    assert sorted(map(tuple, sitetree.extract(pages).collect())) == whole
    monkeypatch.setattr(sitetree, "HOT_SHARE", 1)  # no host is hot
    assert sorted(map(tuple, sitetree.extract(pages).collect())) == whole


def test_markup_deeper_than_paths(spark):
    pages = [f"<div class=top>same</div>{'<div><b>' * 40}story {i}" for i in range(12)]
    rows = spark.createDataFrame([("h", p) for p in pages], "host string, html string")
    got = {x for r in sitetree.site_noise(rows).collect() for x in r.noise}
    assert got == {sitetree.path_hash("/div.top")}
