"""Secrets, decontamination, fingerprints: column results against plain Python."""

import random
import re

import xxhash
from pyspark.sql import functions as F

from catalogwatch.llm import decontaminate, extract, secrets, simhash

SCHEMA = "doc_id long, text string, spans int, base string, fp string, component_id int, h int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "b", "f", 2, 3) for r in rows], SCHEMA)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(spark):
    rng = random.Random(4)
    bits = ["password", "Secret", "api_key", "APIKEY", "token", " ", "=", ":", '"', "'", "abcdef", "AKIA", "ABCDEFGHIJKLMNOP", "deadbeef01234567", "é", "😀", "\n", "x", "ſecret", "toKen"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 5, 20, 80])))) for i in range(300)]
    random_run = "Zq9vK3mN8pR2tW7yB4cD6fG1"
    rows += [(1000, None), (1001, ""), (1002, f"see {random_run} and internationalisation_of_everything"), (1002, f"see {random_run} and internationalisation_of_everything")]
    rows += [(1003, "token: password=abcdefgh"), (None, "password=abcdefgh"), (1004, "secret=abcdef " * 2000)]
    words = frame(spark, [(i, "internationalisation of everything the theory reading online station " * 20) for i in range(50)])
    model = secrets.train(secrets.samples(words))
    found = secrets.find(frame(spark, rows), model=model)
    got = found.select("doc_id", "text", "base", "spans", secrets.redact(found).alias("clean")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [tuple(s) for s in r["base"]] == base_spans(r["text"] or "")
        assert set(map(tuple, r["base"])) <= set(map(tuple, r["spans"]))
    extra = [r for r in got if r["doc_id"] == 1002]
    assert len(extra) == 2 and all([r["text"][s["start"] : s["end"]] for s in r["spans"]] == [random_run] for r in extra)
    assert extra[0]["clean"] == "see [secret] and internationalisation_of_everything"
    assert next(r for r in got if r["doc_id"] == 1004)["clean"].count("[secret]") == 2000
    assert secrets.find(frame(spark, rows).limit(0)).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def hits(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        m = min(13, len(w))
        for a in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[a : a + m]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for m in {len(x) for x in windows}:
            for a in range(len(w) - m + 1):
                if x := windows.get(tuple(w[a : a + m])):
                    found |= x
                    hit |= set(range(a, a + m))
        out.append((d, len(w), len(hit), sorted(x for x in found if x is not None)))
    return sorted(out, key=repr)


def test_decontamination(spark):
    rng = random.Random(3)
    alphabet = "a b c d e é F".split()
    make = lambda sizes: " ".join(rng.choice(alphabet) for _ in range(rng.choice(sizes)))
    for shortest in (0, 13):  # with and without items shorter than a window
        docs = [(i, make([0, 1, 3, 12, 13, 14, 60, 200])) for i in range(200)]
        items = [(i, make([x for x in (0, 3, 5, 6, 12, 13, 20, 40) if x >= shortest])) for i in range(30)]
        docs += [(400 + k, f"{docs[k][1]}\n{items[k][1]}, zz-{items[k + 1][1].upper()}") for k in range(20)]
        docs += [(500, None), (500, None), (None, items[3][1]), (501, (items[4][1] + " zz ") * 500)]
        items += [(None, "q w e r t y u i o p a s d f"), (77, None)]
        a = frame(spark, docs)
        b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, row int")
        got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], sorted(r["items"])) for r in decontaminate.mark(a, b).collect()), key=repr)
        assert got == hits(docs, items)
        assert {r["n_hit"] for r in decontaminate.mark(a, b.limit(0)).collect()} == {0}
        assert decontaminate.mark(a.limit(0), b).count() == 0


def fingerprint(text):
    t = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, ids, near):
    least = {}
    for a in range(len(ids)):
        todo, seen = [a], {a}
        while todo:
            x = todo.pop()
            new = {y for y in range(len(ids)) if y not in seen and near(prints[x], prints[y])}
            seen |= new
            todo += new
        named = [ids[x] for x in seen if ids[x] is not None]
        least[a] = min(named, default=None)
    return least


def test_fingerprints():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 3000):
        text = " ".join(rng.choice(["A", "b\x0b", "é", "\u00a0x", "\u2003", "zz\t\n"]) for _ in range(n))
        assert simhash.fingerprint(text) == fingerprint(text)
    assert simhash.fingerprint(None) == 0


def test_links_of_fingerprints(spark):
    rng = random.Random(2)
    values = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(8):
            y = x
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4])):
                y ^= 1 << b
            values.add(y)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    pairs = simhash.linked_fingerprints(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert sorted((min(p), max(p)) for p in map(tuple, pairs)) == sorted(want)


def test_near_duplicates(spark):
    rows = [(5, "one two three four"), (3, "ONE two  three four"), (9, None), (8, ""), (8, ""), (None, "one two three four"), (4, "x"), (None, "alone here")]
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {(5, 3), (3, 3), (9, 8), (8, 8), (None, 3), (4, 4), (None, None)}
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><body><header><h1>Site</h1></header><div class="cookie-notice">We use</div><nav><ul><li>x</ul></nav><main><article>
<header><h1>T &amp; x</h1></header><p>One<b>two</b> three&nbsp;four<p>Five <ul><li>a<li>b</ul><form>q<input></form><div class="ad">buy</div>
<section id="comments"><article>c</article></section><script>var a="</p>"</script><!-- <p>no --></article><aside>s</aside></main><footer>f</footer>"""


def test_main_text():
    assert extract.main_text(PAGE) == "T & x\nOnetwo three four\nFive\na\nb"
    assert extract.main_text("<p>a < b && c<br/>d</p>text<div>x") == "a < b && c d\ntext\nx"
    for odd in (None, "", "<", "<a", "</", "<p", "<!--", "<script>", "<p class='x>y", "&#xZ; &amp &#0;", "<b><i></b></i>" * 500, "<div>" * 3000 + "deep"):
        assert isinstance(extract.main_text(odd), str)


def test_style_tree_takes_off_what_all_pages_share(spark):
    pages = [(i, "http://h.example/a", f"<body><div class=box><div class=legal>All rights</div></div><div class=story>Text {i} of page</div></body>") for i in range(20)]
    pages += [(100, None, None), (101, "http://other.example/", "<div class=legal>All rights</div>"), (101, "http://other.example/", "<div class=legal>All rights</div>"), (None, "x", "")]
    df = spark.createDataFrame([(*p, 1, "t") for p in pages], "page_id long, url string, html string, host int, text string")
    got = sorted(((r["page_id"] if r["page_id"] is not None else -1, r["text"]) for r in extract.extract(df).collect()))
    assert got == [(-1, ""), *((i, f"Text {i} of page") for i in range(20)), (100, ""), (101, "All rights"), (101, "All rights")]
    assert extract.extract(df.limit(0)).count() == 0


def _copy(k, wrap="<article>{}</article>"):
    body = "<div class=body><p>A story of its own.</p><div class=legal>All rights</div><p>And its end.</p></div>"
    return f"<body><div class=count>{k}</div>{wrap.format(body)}</body>"


def _parted(k):
    body = "".join(f"<section class=s{i}><p>Part {i} of the story.</p></section>" for i in range(3))
    return f"<body><div class=count>{k}</div><article>{body}</article></body>"


def test_copies_of_a_page_keep_their_article(spark):
    whole = "A story of its own.\nAll rights\nAnd its end."
    hosts = {
        "equal": [_copy(0)] * 9,
        "mostly": [_copy(0)] * 40 + [f"<body><article><div class=body><p>Other {i}</p></div></article></body>" for i in range(4)],
        "wrapped": [_copy(0, "<main><div class=wrap>{}</div></main>")] * 9,
        # Copies that differ outside of the article: what most of it is in stays.
        "counted": [_copy(i) for i in range(9)],
        "boxed": [_copy(i, "<div class=box><article>{}</article></div>") for i in range(9)],
        "parted": [_parted(i) for i in range(9)],
        # A shared box that holds an article, beside a page's own longer text, still goes.
        "teaser": [f"<body><div class=latest><article>Read this</article></div><div class=story>Story {i} of this page, which is longer.</div></body>" for i in range(9)],
    }
    rows = [(f"http://{h}/", page) for h, pages in hosts.items() for page in pages]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {}
    for r in sorted(extract.extract(df).collect()):
        got.setdefault(r["url"][7:-1], []).append(r["text"])
    assert got["equal"] == [whole] * 9
    assert got["mostly"] == [whole] * 40 + [f"Other {i}" for i in range(4)]
    assert got["wrapped"] == [whole] * 9
    assert got["counted"] == got["boxed"] == ["A story of its own.\nAnd its end."] * 9
    assert got["parted"] == ["\n".join(f"Part {i} of the story." for i in range(3))] * 9
    assert got["teaser"] == [f"Story {i} of this page, which is longer." for i in range(9)]


def test_fingerprint_keys_are_not_broadcast(spark, tmp_path):
    # 20,000 fingerprints are 0.2 MB by the engine's estimate, their keys some thirty times as many rows.
    spark.range(20_000).select(F.xxhash64("id").alias("fp")).write.parquet(str(tmp_path / "prints"))
    pairs = simhash.linked_fingerprints(spark.read.parquet(str(tmp_path / "prints")))
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
