"""The training-data operators against brute force, on edge cases and on the smallest tables."""

import binascii
import hashlib
import html as html_lib
import math
import re
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallystone.llm import bpe, common, contamination, graph, html, jaccard, langid, minhash, pii, quality, queries, spelling, suffixes, toxicity, urls, vectorcodes

TOKENS = public_tokenizers.path("word_bpe_49k.json")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()

PASSAGE = "one passage of words that several of these documents share in full, " * 3
BENCH = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"), (2, "just four words here"), (3, None), (4, "?!"), (10, "the the the the the the the the the the the the the the"), (2, "just four words here")]
TEXTS = [
    None, "", " ", "?!", "a", "É", "one two three", "one two three", "Line\nLine\nLine\nother",
    "mail a.b@c.example.org or x@y.de_d@e.fr, ip 10.0.0.1 and 999.1.1.1 1.2.3.4.5.6.7.8, card 4111 1111 1111 1111 or 4111-1111-1111-1112, phone +1 (555) 555-2186 and +12 3",
    PASSAGE + "tail one", "head " + PASSAGE, PASSAGE + "tail one", "Ünïcödé " + PASSAGE + " 日本語 😀",
    "say ALPHA beta, gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi end. Just FOUR words; here! just four words", "the " * 30,
    "w" * 5000, "!" * 700, " ".join(f"word{i % 7}" for i in range(3000)), "ab" * 400 + "x" + "ab" * 400,
    " ".join(f"t{i}" for i in range(200)), " ".join(f"t{i}" for i in range(200)) + " extra", " ".join(f"t{i}" for i in range(195)), " ".join(f"t{i if i % 9 else -i}" for i in range(200)),
    "x<|endoftext|>y I'LL it's 12³ ΣΑΣ ﬁ İ", "a\x1cb\x85c d e", "you stupid idiot, worthless trash", "# $ % & " * 20,
]
#: doc_id, text and columns whose names clash with those of the operators.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row long, score double, n_words long, fp long, _text string, lang_pred string"


@pytest.fixture(scope="module")
def docs(spark):
    langs = ["en", "de", None]
    rows = [(i, t, langs[i % 3], None if i % 5 == 0 else f"h{i % 4}", len(t or ""), 7, 0.5, 1, 2, "z", "q") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def odd_ids(docs):
    """Repeated rows, repeated and null ids."""
    return docs.union(docs.where("doc_id in (0, 6, 10)")).union(docs.where("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long"))).union(docs.where("doc_id = 11").withColumn("doc_id", F.lit(10).cast("long"))).cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_empty_tables(spark, docs, bench):
    none, no_items = docs.limit(0), bench.limit(0)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for made in (pii.extract(none), quality.host_quality(none), suffixes.remove_repeats(none), langid.learn_and_identify(none, ["doc_id"]), contamination.contamination(none, bench), bpe.encode(none, ["doc_id"], TOKENS), jaccard.join_ids(none), toxicity.learn_and_score(none, labels, ["doc_id"]), pii.redact(none), jaccard.one_of_each(none), contamination.decontaminated(none, bench), minhash.near_duplicates(none), minhash.one_of_each(none), spelling.variants(none)):
        assert made.count() == 0
    assert html.extract(spark.createDataFrame([], "page_id long, html string"), ["page_id"]).count() == 0
    assert vectorcodes.codes(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string"), ["page_id"], []).count() == 0
    assert contamination.contamination(docs, no_items).where("n_hit > 0 or contaminated").count() == 0
    assert toxicity.learn_and_score(docs, labels, ["doc_id"]).where("predicted = 1").count() == 0


def test_row_key(odd_ids, docs):
    assert common.with_row_key(docs, "doc_id", "k").where("k <> doc_id").count() == 0
    rows = common.with_row_key(odd_ids, "doc_id", "k").select("k", "doc_id").orderBy("k").collect()
    assert len({r.k for r in rows}) == odd_ids.count()
    ids = [r.doc_id for r in rows]
    assert ids == sorted((i for i in ids if i is not None)) + [None]


def test_tables_are_forgotten(spark, docs):
    made = common.materialise(docs, "test")
    assert made.count() == docs.count()
    common.forget(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|not exist"):
        spark.read.parquet(made.inputFiles()[0])


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base(docs):
    for i, r in by_id(pii.extract(docs)).items():
        assert [tuple(x) for x in r.base] == base_spans(TEXTS[i])
        assert set(map(tuple, r.base)) <= set(map(tuple, r.all_spans))


def test_pii_long_runs(spark):
    texts = ["1" * 60000, "a." * 40000, "@" * 5000, "+1" + " " * 30000, "a@b.c " * 3000, "1.2.3.4 " * 2000, "😀 a@b.cc"]
    got = {r.doc_id: r for r in pii.extract(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert [tuple(x) for x in got[i].base] == base_spans(t)


def test_pii_learns_contexts(spark):
    seeds = [(i, f"please dial our number +1 (555) 555-{2000 + i} now") for i in range(8)]
    new = [(100, "please dial our number 555-123-9876 today"), (101, "chapter 555-123-9876 of it")]
    got = {r.doc_id: r for r in pii.extract(spark.createDataFrame(seeds + new, "doc_id long, text string")).collect()}
    assert [tuple(x) for x in got[100].all_spans] == [(23, 3, 35)] and not got[100].base
    assert not got[101].all_spans


CANDIDATE = re.compile(r"(?<!\S)(?=\S*?[0-9@])\S++(?: [(]?[0-9]\S*+)*+")


def refuted(kind, m):
    d = re.sub("[^0-9]", "", m)
    luhn = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]+(\.[0-9]+){3}", m)) and any(int(x) > 255 for x in m.split("."))
    return 14 <= len(d) <= 19 and not luhn if kind == "card" else kind == "phone" and m[0] == "+" and not 10 <= len(d) <= 15


def bootstrapped(texts, rounds=3, least=5, sure=0.8):
    """All spans of each text by plain loops: edges of contexts and instances, rounds of scores, tokens that sure contexts add."""
    found = []
    for i, t in enumerate(texts):
        base = base_spans(t)
        before = lambda b, t=t: [re.sub("[0-9]", "0", " ".join(w).lower()) for n in (2, 1) if len(w := t[:b].split()[-n:]) == n]
        found += [(i, b, e, t[b:e], {k}, 1, before(b)) for b, k, e in base]
        for m in CANDIDATE.finditer(t or ""):
            if not any(b < m.end() and m.start() < e for b, _, e in base):
                lead = len(re.match(r"[^0-9A-Za-z+(@]*", m[0])[0])
                core = re.match(r"[^0-9A-Za-z+(@]*(.*?)[^0-9A-Za-z)]*$", m[0])[1]
                kinds = {k for k, kind in enumerate(pii.KINDS) if re.search(pii.SHAPES[kind], core) and not refuted(kind, core)}
                if len(core) > 4 and kinds:
                    found.append((i, m.start() + lead, m.start() + lead + len(core), core, kinds, 0, before(m.start())))
    edges = {}
    for _, _, _, hit, kinds, seed, contexts in found:
        for k in kinds:
            for p in contexts:
                was, n = edges.get((k, p, hit.lower()), (0, 0))
                edges[k, p, hit.lower()] = (max(seed, was), n + 1)
    total = Counter()
    for t in texts:
        words = re.sub("[0-9]", "0", (t or "").lower()).split()
        for i in range(len(words) - 1):
            total[words[i]] += 1
            total[" ".join(words[i - 1 : i + 1])] += i > 0
    belief = {(k, x): float(s) for (k, p, x), (s, _) in edges.items()}
    for n in range(rounds):
        confidence = {}
        for k, p in {e[:2] for e in edges}:
            c = [(1.0 if s else belief[a, x] * (n > 0), m) for (a, q, x), (s, m) in edges.items() if (a, q) == (k, p)]
            if sum(v >= sure for v, _ in c) >= least:
                confidence[k, p] = sum(v * m for v, m in c) / (max(total[p], sum(m for _, m in c)) + 1)
        belief = {(k, x): 1 - np.prod([1 - confidence.get((k, p), 0) for (a, p, y) in edges if (a, y) == (k, x)]) for k, _, x in edges}
    out = [[(b, k, e) for b, k, e in base_spans(t)] for t in texts]
    for i, b, e, _, kinds, seed, contexts in found:
        best = max(((confidence[k, p], -k) for k in kinds for p in contexts if confidence.get((k, p), 0) >= sure), default=None)
        if not seed and best:
            out[i].append((b, -best[1], e))
    return [sorted(x) for x in out]


def test_pii_bootstraps(spark):
    """Contexts of seeds discover identifiers; these make contexts without any seed sure, which discover further ones."""
    texts = [f"please dial our number +1 (555) 555-{2000 + i} now" for i in range(30)]
    texts += [f"please dial our number 555-123-{4000 + i} today" for i in range(20)] + [f"ring reception desk 555-123-{4000 + i} again" for i in range(20)]
    texts += ["ring reception desk 555-777-1234 again", "page 12 of 555-123-9999", "mail a@b.cc or a@b.cc or x at 10.0.0.1, 300.1.2.3", "", "longest" * 20 + " word 555-123-4001"]
    got = by_id(pii.extract(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    expected = bootstrapped(texts)
    assert [[tuple(x) for x in got[i].all_spans] for i in range(len(texts))] == expected
    assert expected[70] and not base_spans(texts[70]) and not expected[71]


def test_pii_context_of_everything_teaches_nothing(spark):
    """Numbers that fail their check stay out, though cards stand before and after the same word; a planted context still teaches."""
    cards = ["4111 1111 1111 1111", "5500 0000 0000 0004", "3400 0000 0000 009", "6011 0000 0000 0004", "3530 1113 3330 0000", "4012 8888 8888 1881"]
    texts = [f"the {c} and the other of the rest in the end" for c in cards] + ["the 4111 1111 1111 1112 is none", "the 4111 1111 1111 and more"]
    texts += [f"my account ref. {c} thanks" for c in cards * 5] + ["my account ref. 4111 1111 1111 thanks", "my account ref. 4111 1111 1111 1113 thanks", "server at 300.1.2.3 now", "of +12 34 now"]
    got = by_id(pii.extract(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [[tuple(x) for x in got[i].all_spans] for i in range(len(texts))] == bootstrapped(texts)
    assert not any(got[i].all_spans for i in (6, 7, 39, 40, 41)) and [tuple(x) for x in got[38].all_spans] == [(16, 2, 30)] and not got[38].base


def test_redaction(docs, odd_ids):
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    for i, t in enumerate(TEXTS):
        spans, out, at = base_spans(t), "", 0
        for b, k, e in spans:
            if b >= at:
                out += t[at:b] + f"[{list(PATTERNS)[k].upper()}]"
            at = max(at, e)
        assert got[i] == (None if t is None else out + t[at:])
    assert pii.redact(docs).columns == docs.columns and pii.redact(odd_ids).count() == odd_ids.count()


def stats(text, word=re.compile(r"[^\x20\x09-\x0D]+")):
    text = text or ""
    words, seen, dup = word.findall(text), set(), 0
    for line in text.split("\n"):
        if word.search(line):
            dup += line in seen
            seen.add(line)
    grams, hit = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)), set()
    for i in range(len(words) - 4):
        if grams[tuple(words[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), dup, len(hit)


def test_quality(docs, odd_ids):
    for i, r in by_id(quality.host_quality(docs)).items():
        expected = stats(TEXTS[i])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0])
        assert not (r.base_failed and r.kept)
    assert quality.host_quality(odd_ids).count() == odd_ids.count()


def test_host_verdicts(spark):
    good, bad, odd = "plain words of a normal length that fill a line of prose well enough", "too short", "# odd # but # long # enough # text # with # marks # in # it # all"
    rows = [(i, good, f"clean{i % 3}") for i in range(300)] + [(1000 + i, bad, "junk") for i in range(50)] + [(2000, good, "junk"), (2001, odd, "clean1"), (3000, good, None)] + [(4000 + i, odd if i % 2 else good, "half") for i in range(40)]
    got = by_id(quality.host_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert got[0].kept and got[2001].kept and got[3000].kept and not got[2000].kept
    assert got[0].host_verdict == got[2001].host_verdict == "keep"
    assert got[2000].host_verdict == "drop" and got[4000].host_verdict == "strict" and got[4000].kept and not got[4001].kept
    p, n = [r.host_rate for r in (got[0], got[1000])]
    assert 0 < p < 0.1 and 0.9 < n < 1


def test_host_verdicts_act_on_the_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    made = quality.host_quality(docs).select("source", "host_verdict", "base_failed", "soft_failed", "kept").collect()
    hosts = {r.source: r.host_verdict for r in made}
    assert {"keep", "strict"} <= set(hosts.values())
    for r in made:
        assert r.kept == (not r.base_failed and not (hosts[r.source] == "strict" and r.soft_failed) and hosts[r.source] != "drop")
    assert any(r.kept and r.soft_failed for r in made) and any(not r.kept and not r.base_failed for r in made)


def removed(texts):
    """doc order is list order: which bytes a 100-byte string that also starts earlier covers."""
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        out.append((len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def test_suffixes(docs):
    expected = removed(TEXTS)
    for i, r in by_id(suffixes.remove_repeats(docs, output=True)).items():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[i]
        assert sha(bytes(r.kept)) == r.kept_sha256


def test_suffixes_of_repeated_rows(spark):
    rows = [(5, "q" + PASSAGE), (5, "q" + PASSAGE), (None, PASSAGE), (1, PASSAGE), (9, "x" + PASSAGE[:150])]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    n = len(PASSAGE.encode())
    inside = removed([PASSAGE])[0][1]
    assert got == [(False, 1, inside), (False, 5, n), (False, 5, n + 1), (False, 9, 150), (True, 0, n)]


def test_suffixes_over_part_borders(spark, monkeypatch):
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abcdé \n"), 3000)) for _ in range(6)]
    texts += [texts[0][500:2500] + texts[1][:900], texts[2], "z" + texts[3][:101], texts[4][:99]]
    monkeypatch.setattr(suffixes, "PART", 512)
    expected = removed(texts)
    parts = [(i, *p[1:]) for i, t in enumerate(texts) for p in suffixes.cut(i, t.encode())]
    windows = sum(n for p in parts for n in suffixes.runs([p])[4])
    assert windows == sum(max(0, len(t.encode()) - 99) for t in texts)
    for i, r in by_id(suffixes.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).items():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[i]


ARTICLE = "<h1>A &amp; B</h1><p>First <b>bold<br>text here</b> of the story, which goes on for a while.</p>\n<ul><li>One</li><li>Two&nbsp;x</li></ul><p>Last words of this long enough article text.</p>"
EXPECTED = "A & B First bold text here of the story, which goes on for a while. One Two x Last words of this long enough article text."


@pytest.mark.parametrize("page", [
    f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><a href=x>Menu</a></nav><div class='ad'>Buy now please</div><article>{ARTICLE}</article><footer>foot</footer></body></html>",
    f"<body><header>Site</header><div id=main>{ARTICLE}</div><aside>side</aside><div class='cookie-notice'>We use cookies</div><section id='comments'><p>I think so too, a long reader comment here.</p></section></body>",
    f"<main><form><label>Mail</label><input></form>{ARTICLE}<div class='sidebar'><p>Other stories you may like.</p></div></main>",
])
def test_main_text(page):
    assert html.main_text(page) == EXPECTED


def test_html_pages(spark, sf_dir):
    assert [html.main_text(x) for x in (None, "", "<p>", "plain text", "<div>a<", "<!-- x --><nav>n</nav>")] == ["", "", "", "plain text", "a<", ""]
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    made = {r.page_id: r for r in html.extract(pages.withColumn("text", F.lit(1)), ["page_id", "url"]).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        assert made[r.page_id].text == " ".join(html_lib.unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", inner))).split())
        assert made[r.page_id].n_chars == len(made[r.page_id].text)


def stripped(page):
    """A page without the tags and names that mark its parts: only its density tells them apart."""
    return re.sub(r"<(/?)(article|nav|footer|aside|header)\b", r"<\1div", page).replace('class="ad"', 'class="x"')


SOUP = "<body><div><a href=1>Home</a></div><div><a href=2>News</a></div><div>Buy now</div><div class=q>" + ARTICLE + "<p>Of.</p></div><div><a href=3>Terms</a></div><div>(c) 2020</div></body>"


def test_ratio_decides(spark, sf_dir, monkeypatch):
    """Pages without telling tags and names: the clusters of the ratio find the article, and nothing does without them."""
    pages = [r.html for r in spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/pages.parquet").select("html").collect()]
    share = lambda: np.mean([html.main_text(stripped(p)) == html.main_text(p) for p in pages])
    whole = EXPECTED + " Of."
    assert html.main_text(SOUP) == whole
    right = share()
    cluster = html.in_content
    monkeypatch.setattr(html, "in_content", lambda ratio: np.ones(len(ratio), bool))
    assert html.main_text(SOUP) != whole and share() < right - 0.2
    monkeypatch.setattr(html, "in_content", lambda ratio: ~cluster(ratio))
    assert html.main_text(SOUP) != whole and share() < 0.1
    assert right > 0.8


def test_ambiguous_names_are_judged_by_density():
    page = "<body><nav>Menu</nav><div id=main>{}<section id='discussion'><p>We discuss what these results mean for the field at some length and in full sentences.</p></section><div class='related'><a href=1>One</a> <a href=2>Two</a></div></div></body>"
    made = html.main_text(page.format(ARTICLE))
    assert made == EXPECTED + " We discuss what these results mean for the field at some length and in full sentences."


@pytest.mark.parametrize("page,text", [
    ("<![foo[ x ]]> <p>hello</p>", "hello"), ("<p>x</p><!-- unclosed", "x"), ("<p>x</p><!doctype", "x"), ("<p>x</p><?php y", "x"), ("<p>x</p><b class='y", "x"), ("<p>x</p></p", "x"), ("<!--> hi <p>y", "hi y"), ("<p>a</p><!-- x --!> b", "a b"), ("<![CDATA[ x ]]><p>a &amp; b", "a & b"),
])
def test_broken_markup(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("page", ["<b>" * 20000 + "</i>" * 20000, "<b>" * 20000 + "<p>x" * 20000, "<div>x" * 20000, "<!--" * 50000, "<a " * 50000, "</" * 50000, "<![x[" * 50000, "<table><tr><td>" * 10000])
def test_deep_pages_take_linear_time(page):
    import time

    began = time.perf_counter()
    html.main_text(page)
    assert time.perf_counter() - began < 5


def judge(url, rules):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
        host = host.translate(UP)
    fits = []
    for rule, verdict in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), len(h), rule, verdict))
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_urls(spark):
    given = [None, "", "no scheme", "http://NET", "http://net/", "https://a.Example.NET/en/x?y#z", "http://example.net/english", "http://badexample.com/de/", "x://example.com/de/", "x://www.example.com:80/de/", "http://o.org/fr/a://b", "http://o.org?fr/", "ftp://u@net/x", "http://net./", "a://b\n.net/\nx"]
    rules = [*urls.RULES, ("b.example.net/", "block"), ("net/", "block")]
    made = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(list(enumerate(given)), "page_id long, url string"), ["page_id"], rules).collect()}
    for i, u in enumerate(given):
        assert (made[i].host, made[i].path, made[i].rule, made[i].verdict) == judge(u, rules), u


def test_url_collisions(monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda x: 7)
    import tempfile

    with tempfile.NamedTemporaryFile() as f:
        f.write(urls.pack(urls.RULES))
        f.flush()
        table = urls.Digests(f.name)
        assert table.judge(["x.net", "example.net", "q.com"], ["/", "/en/", "/"]) == [("net/", True), ("example.net/en/", False), (None, False)]


def test_language(spark, docs, sf_dir):
    real = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    made = langid.learn_and_identify(real, ["doc_id", "lang"]).withColumn("held", common.fold("doc_id", 4) == 2)
    assert made.where("held").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    assert made.where("score < 0 or score > 1").count() == 0
    for i, r in by_id(langid.learn_and_identify(docs, ["doc_id"])).items():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in TEXTS[i] or ""))
    kept = langid.in_known_language(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_unlearned_languages_are_dropped(spark, sf_dir):
    """Planted noise and unlearned languages in three scripts go; nothing of the learned languages goes, however short."""
    real = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    rng = np.random.default_rng(5)
    word = lambda letters: "".join(rng.choice(list(letters), rng.integers(3, 10)))
    scripts = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"]
    noise = [" ".join(word(s) for _ in range(n)) for s in scripts for n in (30, 100, 1000) for _ in range(20)] + [word(s) for s in scripts[1:] for _ in range(5)]
    unlearned = [
        "Wczoraj wieczorem poszliśmy do starego kina na rogu ulicy i obejrzeliśmy długi film o podróży przez góry",
        "Eilen illalla kävelimme vanhaan elokuvateatteriin kadun kulmassa ja katsoimme pitkän elokuvan matkasta vuorten yli",
        "Вчера вечером мы пошли в старый кинотеатр на углу улицы и посмотрели длинный фильм о путешествии через горы",
        "Χθες το βράδυ πήγαμε στο παλιό σινεμά στη γωνία του δρόμου και είδαμε μια μεγάλη ταινία για ένα ταξίδι",
    ]
    planted = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(noise + unlearned)], "doc_id long, text string")
    kept = {r.doc_id for r in langid.in_known_language(real.unionByName(planted, allowMissingColumns=True)).select("doc_id").collect()}
    assert not {i for i in kept if i < 0}
    lost = {r.doc_id for r in real.where("lang is not null").select("doc_id").collect()} - kept
    assert len(lost) <= real.count() / langid.RARE


def test_language_limit_has_no_step():
    """What a text must reach grows with its length without a step, from nothing to the limit of long texts."""
    n = np.arange(0, 200_000)
    asked = langid.weight(n, 170.0)
    assert (asked[: langid.LEAST + 1] == 0).all() and (np.diff(asked) >= 0).all() and np.diff(asked).max() < 0.03 and asked[-1] > 0.999
    grams = np.random.default_rng(1).zipf(1.3, 20_000) % 500
    vectors = np.random.default_rng(2).choice([-1.0, 1.0], (500, 1024))
    whole = vectors[grams].sum(0)
    half = langid.halves({"x": whole}, {"x": float(len(grams))})["x"]
    for k in (50, 200, 1000):  # the expectation holds for drawn 3-grams
        drawn = vectors[np.random.default_rng(k).choice(grams, (200, k))].sum(1)
        cosine = (drawn @ whole) / np.linalg.norm(drawn, axis=1) / np.linalg.norm(whole)
        assert abs(cosine.mean() - (k / (k + half)) ** 0.5) < 0.02


def test_language_bundles(monkeypatch):
    texts = [" ab ", "", " abc abd ", " ab "]
    whole = langid.bundle(texts, 64)
    monkeypatch.setattr(langid, "PART", 3)
    assert np.allclose(whole, langid.bundle(texts, 64))
    made = langid.bundle(texts, 64)
    for row, t in zip(made, texts):
        v = np.zeros(64)
        for i in range(len(t) - 2):
            a, b, c = (langid.letter(ord(x), 64) for x in t[i : i + 3])
            v += np.roll(a, 2) * np.roll(b, 1) * c
        assert np.allclose(row, v)
    assert np.allclose(langid.bundle(texts, 64, np.array([1, 0, 1, 0]), 2), [made[1] + made[3], made[0] + made[2]])


def contaminated(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))
    words, hit, found = split(text), set(), set()
    for item, t in items:
        ws = split(t)
        n = min(13, len(ws))
        for s in range(len(ws) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == ws[s : s + n]:
                    hit.update(range(i, i + n))
                    found.add(str(item))
    return len(words), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(words)


def test_contamination(docs, bench, odd_ids, monkeypatch):
    for most in (contamination.MOST_BROADCAST, 0):
        monkeypatch.setattr(contamination, "MOST_BROADCAST", most)
        for i, r in by_id(contamination.contamination(docs, bench)).items():
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == contaminated(TEXTS[i], BENCH)
    assert contamination.contamination(odd_ids, bench).count() == odd_ids.count()
    clean = contamination.decontaminated(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, t in enumerate(TEXTS) if not contaminated(t, BENCH)[4]}


def test_words_are_not_shuffled_with_their_text(docs, bench, monkeypatch):
    """Beyond the broadcast's limit single words are shuffled, and a text once for each row that has hits."""
    monkeypatch.setattr(contamination, "MOST_BROADCAST", 0)
    rows = common.with_row_key(docs.select("doc_id", "text"), "doc_id")
    keys = bench.sparkSession.createDataFrame([("alpha",)], "key string")
    plan = contamination.postings(rows, keys, 1, "text", 12)._jdf.queryExecution().optimizedPlan().toString()
    shuffled = [line for line in plan.split("\n") if "Generate posexplode" in line]
    assert len(shuffled) == 1 and "_words" not in shuffled[0].split("],")[-1]


def test_items_without_id_are_found(spark):
    docs = spark.createDataFrame([(1, "just four words here"), (2, "say alpha beta gamma"), (3, "nothing of these")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "just four words here"), (None, "alpha beta gamma"), (7, "beta gamma")], "item_id long, text string")
    made = {i: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for i, r in by_id(contamination.contamination(docs, items)).items()}
    assert made == {1: (4, 0, sha(""), True), 2: (3, 1, sha("7"), True), 3: (0, 0, sha(""), False)}
    assert [r.doc_id for r in contamination.decontaminated(docs, items).collect()] == [3]


def test_proximity(docs, bench):
    rows = common.with_row_key(docs.select("doc_id", "text"), "doc_id")
    got = {(r._row, r.item_id) for r in contamination.proximity_matches(rows, bench, slop=3).collect()}
    assert (14, "2") in got and (14, "1") in got and (20, "1") not in got


def test_bpe(docs):
    own = Tokenizer.from_file(TOKENS)
    own.no_truncation()
    own.no_padding()
    made = by_id(bpe.encode(docs, ["doc_id"], TOKENS, ids=True))
    for i, t in enumerate(TEXTS):
        ids = own.encode(t or "", add_special_tokens=False).ids
        r = made[i]
        assert r.token_ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == sha(" ".join(map(str, ids))) and r.decoded_sha256 == sha(own.decode(ids, skip_special_tokens=False))
    texts = bpe.decode(bpe.encode(docs, ["doc_id"], TOKENS, ids=True), TOKENS)
    assert all(r.decoded == own.decode(r.token_ids, skip_special_tokens=False) for r in texts.collect())


def test_bpe_forgets_words_it_cannot_hold(monkeypatch):
    own = Tokenizer.from_file(TOKENS)
    monkeypatch.setattr(bpe, "MOST_WORDS", 5)
    tool = bpe.Bpe(open(TOKENS).read())
    for text in ("some words of a text that is long", "some other words", "<|endoftext|>"):
        assert tool.encode([text])[0].tolist() == own.encode(text, add_special_tokens=False).ids


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} - {()}


def components_of(sets, percent=85):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_jaccard(docs, odd_ids):
    sets = {i: shingles(t) for i, t in enumerate(TEXTS)}
    expected = components_of(sets)
    made = by_id(jaccard.join_ids(docs))
    assert {i: (r.n_shingles, r.component_id) for i, r in made.items()} == {i: (len(sets[i]), expected[i]) for i in sets}
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(expected.values())
    assert jaccard.join_ids(odd_ids).count() == odd_ids.count()


@pytest.mark.parametrize("n2,k2", [(2, 1), (3, 1), (4, 2)])
def test_jaccard_loses_no_link(spark, n2, k2):
    """Chains of near copies at all distances around the threshold, of many sizes."""
    rng = np.random.default_rng(n2)
    texts = []
    for size in (5, 8, 12, 30, 60, 150, 400):
        base = [f"s{size}w{i}" for i in range(size)]
        for copy in range(14):
            words = list(base)
            for at in rng.choice(size, int(size * copy * 0.004) + copy % 2, replace=False):
                words[at] = f"c{copy}x{at}"
            texts.append(" ".join(words[: size - copy % 4] if copy % 3 else words))
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    rows = spark.createDataFrame(list(enumerate(texts)), "_row long, text string")
    made = {r._row: r.component for r in jaccard.similar_components(rows, n2=n2, k2=k2).collect()}
    assert made == components_of(sets)


def test_signatures_are_shared():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        drop = int(rng.integers(0, max(1, n // 6)))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 8))), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both) and not np.array_equal(a, b):
            assert len(np.intersect1d(jaccard.signatures(a, 85, 2, 1), jaccard.signatures(b, 85, 2, 1)))


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [tuple(map(int, rng.integers(0, 90, 2))) for _ in range(60)] + [(500, i) for i in range(501, 520)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_toxicity(spark, sf_dir):
    where = sf_dir.replace("0.001", "0.1")
    d, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    made = toxicity.learn_and_score(d, labels, ["doc_id"]).join(labels, "doc_id").where(common.fold("doc_id", 3) == 1)
    n = Counter((r.toxic, r.predicted) for r in made.select("toxic", "predicted").collect())
    assert n[1, 1] / (n[1, 1] + n[1, 0]) >= 0.87 and n[1, 1] / (n[1, 1] + n[0, 1]) >= 0.95
    assert made.where("score < 0 or score > 1").count() == 0


def votes_of_two_languages(seed, n):
    """Voters 0-2 go together in one language and 3-4 in another; a class shows itself in its own language alone."""
    rng = np.random.default_rng(seed)
    y, tongue = rng.random(n) < 0.2, rng.random(n) < 0.3
    fire = lambda p1, p0, where: rng.random(n) < np.where(where, np.where(y, p1, p0), 0)
    a, b = fire(0.9, 0.02, ~tongue), fire(0.9, 0.02, tongue)
    v = np.stack([a, a & (rng.random(n) < 0.9), fire(0.5, 0.05, ~tongue), b, b & (rng.random(n) < 0.8), fire(0.3, 0.1, tongue)], 1)
    return v.astype(np.float32), y.astype(int)


def test_label_model():
    """EM against loops, and posteriors that differ from the labels they were drawn from, which the model doesn't see."""
    (known, labels), (votes, hidden) = votes_of_two_languages(1, 80), votes_of_two_languages(2, 60)
    q, parent = toxicity.label_model(votes, known, labels, rounds=3)
    both, n, m = np.vstack([votes, known]), len(votes), votes.shape[1]
    share, odds, mine = 2.0 * n / len(known), np.log(labels.mean() / (1 - labels.mean())), None
    for _ in range(3):
        w = [[(0 if mine is None else mine[i] if c else 1 - mine[i]) for i in range(n)] + [share * float(y == c) for y in labels] for c in (0, 1)]
        parents = toxicity.forest(both, tuple(map(np.array, w))) if mine is None else parents
        mine = []
        for i in range(n):
            z = odds
            for c, sign in ((1, 1), (0, -1)):
                s = sum(w[c])
                if not both[i].any():
                    z += sign * np.log(1 - np.clip((sum(k for k, v in zip(w[c], both) if v.any()) + 1) / (s + 2), 0.001, 0.999))
                for j in range(m):
                    p = parents[j]
                    on = [p >= 0 and v[p] for v in both]
                    above, together, fires = (sum(k for k, o, v in zip(w[c], on, both) if f(o, v[j])) for f in (lambda o, x: o, lambda o, x: o and x, lambda o, x: x))
                    pooled = (sum(x + y for x, y, o, v in zip(*w, on, both) if o and v[j]) + 0.005) / (sum(x + y for x, y, o in zip(*w, on) if o) + 0.01)
                    given, alone = (together + 5 * pooled) / (above + 5), (fires - together + 0.5 * fires / s + 1e-3) / (s - above + 0.5)
                    z += sign * (np.log(given if on[i] else alone) if both[i, j] else np.log1p(-given) if on[i] else 0)
            mine.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    assert np.allclose(q, mine, atol=1e-3) and list(parent) == list(parents)
    (known, labels), (votes, hidden) = votes_of_two_languages(1, 400), votes_of_two_languages(2, 700)
    full, parent = toxicity.label_model(votes, known, labels)
    assert parent[1] == 0 or parent[0] == 1
    assert np.mean((full > 0.5) == hidden) > 0.9 and 5 < np.sum((full > 0.5) != hidden)


def test_posteriors_are_not_the_labels(spark, sf_dir):
    """On the tables the classifier learns from posteriors: with the labels as targets its weights are others."""
    where = sf_dir.replace("0.001", "0.01")
    d, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    seen = []
    fit = toxicity.fit_linear
    toxicity.fit_linear = lambda votes, target: seen.append((votes, target)) or fit(votes, target)
    try:
        weights, _ = toxicity.train(d, labels)
    finally:
        toxicity.fit_linear = fit
    target = seen[0][1]
    assert weights and len(target) != labels.count() and ((target > 0.01) & (target < 0.99)).any()


def test_clashing_labels_of_one_id(spark):
    """Toxic wins, whatever the order of rows; the fit doesn't depend on partitions."""
    rows = [(i, f"awful{'' if i % 2 else 'ly'} word and text number n{chr(97 + i % 26)}{chr(97 + i // 26)}" if i % 3 == 0 else f"plain text of q{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(300)]
    labels = [(i, int(i % 3 == 0)) for i, _ in rows] + [(i, 0) for i, _ in rows]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    fits = [toxicity.train(d.repartition(n), spark.createDataFrame(labels[::step], "doc_id long, toxic int").repartition(n)) for n, step in ((1, 1), (5, -1))]
    assert fits[0][0].keys() == fits[1][0].keys() and "awfu*" in fits[0][0] or "awful*" in fits[0][0] or "awful" in fits[0][0]
    assert all(abs(fits[0][0][k] - fits[1][0][k]) < 1e-6 for k in fits[0][0])


def test_folds(docs):
    for r in docs.select("doc_id", common.fold("doc_id", 4).alias("f")).collect():
        assert r.f == binascii.crc32(str(r.doc_id).encode()) % 4


def test_minhash(docs, odd_ids):
    want = components_of({i: shingles(t) for i, t in enumerate(TEXTS)}, 80)
    got = by_id(minhash.near_duplicates(docs))
    assert all((got[i].n_shingles, got[i].component_id, got[i].kept) == (len(shingles(t)), want[i], want[i] == i) for i, t in enumerate(TEXTS))
    assert minhash.near_duplicates(odd_ids).count() == odd_ids.count()
    one = minhash.one_of_each(docs)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == set(want.values())


@pytest.mark.parametrize("percent,width", [(80, 5), (50, 1)])
def test_minhash_loses_no_link(spark, percent, width):
    """Near copies of one text whose links are few: hubs don't join them all, so the buckets' rest must."""
    rng = np.random.default_rng(percent)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):
        words, at = list(base), rng.choice(120, rng.integers(1, 12 if width > 1 else 60), replace=False)
        for j in at:
            words[j] = f"x{i}-{j}" if i % 3 else f"y{j}"
        texts.append(" ".join(words))
    sets = {i: {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} for i, w in enumerate(map(str.split, texts))}
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = by_id(minhash.near_duplicates(rows, percent=percent, width=width))
    assert {i: r.component_id for i, r in got.items()} == components_of(sets, percent)


def test_minima():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 2**64, n, dtype=np.uint64) for n in (1, 7, 500)]
    a, b = minhash.family(16)
    for row, s in zip(minhash.minima(sets, 16), sets):
        assert row.tolist() == [min((int(x) * int(m) + int(c)) % 2**64 for x in s) >> 32 for m, c in zip(a, b)]
    assert 60 <= minhash.least_agreeing(80, 128) <= 80


def spelling_brute(rows, min_length=7, min_count=2):
    """The contract by plain loops."""
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            run = run.translate(UP)
            h = binascii.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    near = {w: [] for w in words}
    for a, b in near_brute(words):
        near[a].append(b)
        near[b].append(a)
    best = {w: min(v, key=lambda o: (-words[o], o), default=None) for w, v in near.items()}
    form = {w: b if b and words[b] >= 10 * words[w] else None for w, b in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def near_brute(words):
    """Pairs that share what is left without one code point, at one place, or of which one is what is left of the other."""
    words, found = set(words), set()
    left = {}
    for w in words:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            left.setdefault((i, rest), []).append(w)
            if rest in words:
                found.add(tuple(sorted((w, rest))))
    return found | {tuple(sorted((a, b))) for ws in left.values() for a in ws for b in ws if a < b}


def test_spelling(docs, odd_ids):
    for rows in (docs, odd_ids):
        want = spelling_brute([(r.doc_id, r.text) for r in rows.collect()])
        assert {tuple(r) for r in spelling.variants(rows).collect()} == want


def test_spelling_chains(spark):
    words = {"banananas": 3000, "banananaz": 200, "banananazz": 15, "banenanazz": 1, "banananass": 300, "ananananan": 40, "anananana": 4}
    rows = [(1000 * k + i, w) for k, (w, n) in enumerate(words.items()) for i in range(n + 1)] + [(None, "Banananas"), (7, None)]
    got = {tuple(r) for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == spelling_brute(rows)
    assert any(r[1] and r[1] != r[2] for r in got)


@pytest.mark.parametrize("alphabet,most", [("ab", 3), ("ab", 100_000), ("abcdeé", 50), ("aß", 1)])
def test_near_words(spark, alphabet, most):
    """Every pair is found, for few letters too, where grams repeat within a word and nearly all are frequent."""
    rng = np.random.default_rng(len(alphabet) + most)
    words = {"".join(rng.choice(list(alphabet), rng.integers(7, 13))) for _ in range(1500)} | {"a" * n for n in (7, 8, 9, 3000, 3001)} | {"b" * 40 + "a" * 40, "b" * 40 + "a" * 39}
    rows = spark.createDataFrame([(w, 2) for w in sorted(words)], "word string, n long").repartition(3)
    got = [(r.a, r.b) for r in spelling.near_words(rows, most=most).collect()]
    assert len(got) == len(set(map(frozenset, got)))
    assert {tuple(sorted(p)) for p in got} == near_brute(words)


def test_grams_bound_what_an_edit_spoils():
    rng = np.random.default_rng(5)
    frequent = {"ab": 50, "ba": 40, "aba": 30, "aa": 60, "aaa": 20, "bab": 9, "aaaa": 5}
    for _ in range(300):
        w = "".join(rng.choice(list("ab"), rng.integers(7, 12)))
        found, bound = spelling.grams(w, frequent)
        at = int(rng.integers(0, len(w)))
        for other in (w[:at] + w[at + 1 :], w[:at] + "c" + w[at:], w[:at] + "c" + w[at + 1 :], w + "b"):
            rest = Counter(g for g, _ in spelling.grams(other, frequent)[0])
            assert sum((Counter(g for g, _ in found) & rest).values()) >= len(found) - bound


def lloyd(rows, parts=16, entries=64, rounds=2, scale=256):
    """Codes, errors and codebooks of (id, vector) by plain rounds over all entries."""
    kept = sorted((i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    size = len(kept[0][1]) // parts
    cut = [[tuple(v[p * size : (p + 1) * size]) for p in range(parts)] for _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, code in zip(cut, codes) if code[p] == e]
                if mine:
                    books[p][e] = tuple(sum(x) // len(mine) for x in zip(*mine))
    codes = assign()
    errors = [sum(far(c[p], books[p][code[p]]) for p in range(parts)) for c, code in zip(cut, codes)]
    return {i: ("".join(f"{e:02x}" for e in code), error) for (i, _), code, error in zip(kept, codes, errors)}, books


def test_vector_codes(spark):
    rng = np.random.default_rng(13)
    vectors = [[float(np.float32(x)) for x in v] for v in np.round(rng.normal(0, 0.02, (300, 32)) * 64) / 64 + rng.choice([0, 0.5], (300, 1))]
    rows = [(i, v, None if i % 7 == 0 else i % 3, 9) for i, v in enumerate(vectors)] + [(500, None, 1, 0), (501, [None] + [0.0] * 31, 1, 0), (502, [float("nan")] * 32, None, 0), (503, [float("inf")] + [0.0] * 31, 1, 0), (504, vectors[0], 2, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code int").repartition(5)
    want, books = lloyd([(i, v) for i, v, *_ in rows])
    got = {r.vec_id: r for r in vectorcodes.codes(df).collect()}
    assert {i: (r.code, r.error) for i, r in got.items()} == want
    sums = Counter()
    for i, _, label, _ in rows:
        sums[label] += want.get(i, ("", 0))[1]
    assert all(got[i].label_error == sums[label] for i, _, label, _ in rows if i in got)
    digest = sha(",".join(str(x) for p in books for e in p for x in e))
    assert {r.codebooks_sha256 for r in got.values()} == {digest}
    coded, learnt = vectorcodes.compress(df)
    back = {r.id: r.v for r in vectorcodes.decompress(coded, learnt).collect()}
    assert all(sum((math.floor(256 * x) - y) ** 2 for x, y in zip(vectors[i], back[i])) == want[i][1] for i in range(300))


def test_active_entries_give_what_all_entries_give():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, old = rng.integers(-3, 4, (200, 2)), rng.integers(-3, 4, (9, 2))
        code, far = vectorcodes.nearest(x, old)
        new = np.where(rng.random((9, 1)) < 0.4, rng.integers(-3, 4, (9, 2)), old)
        got = vectorcodes.reassign(x, code, far, new, (new != old).any(1))
        assert all((a == b).all() for a, b in zip(got, vectorcodes.nearest(x, new)))


def test_vectors_of_odd_sizes(spark):
    """Few rows, repeated and null ids, short, empty and huge vectors."""
    rows = [(1, [1.0, 2.0, 3.0], 1), (1, [1.0, 2.0, 3.0], 1), (None, [], None), (2, [1e30] * 20, None), (3, [-1e30], 1)]
    got = vectorcodes.codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id or 0) for r in got) == [0, 1, 1, 2, 3] and all(r.error == 0 and len(r.code) == 32 for r in got)


def test_kept_columns_that_clash_give_way(spark, docs):
    """Each operator's own columns win over kept ones of their names; the other kept ones come through."""
    pages = spark.createDataFrame([(1, "u", "https://a.example.net/en/x", "<p>some text of a page</p>", 9, "x", "y")], "page_id long, text string, url string, html string, n_chars int, host string, verdict string")
    made = html.extract(pages, ["page_id", "text", "n_chars", "host"])
    assert made.columns == ["page_id", "host", "text", "n_chars"] and made.first().text == "some text of a page"
    judged = urls.filter_urls(pages, ["page_id", "host", "verdict", "n_chars"], urls.RULES)
    assert len(set(judged.columns)) == len(judged.columns) and judged.first().host == "a.example.net" and judged.first().n_chars == 9
    labels = spark.createDataFrame([(9, 0), (26, 1)], "doc_id long, toxic int")
    for df, own in ((langid.learn_and_identify(docs, ["doc_id", "lang_pred", "score", "fp"]), "lang_pred"), (bpe.encode(docs, ["doc_id", "n_words", "fp"], TOKENS), "n_tokens"), (toxicity.learn_and_score(docs, labels, ["doc_id", "score", "fp"]), "score")):
        assert len(set(df.columns)) == len(df.columns) and {"doc_id", "fp", own} <= set(df.columns)
        assert df.where("fp <> 2").isEmpty() and df.count() == docs.count()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, sf_dir, name):
    """One row for each row of the table, whatever the query; op11 has one for each word."""
    source = {"op4": "pages", "op5": "pages", "op13": "embeddings"}.get(name.split("_")[0], "documents")
    rows = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    want = spelling.word_counts(rows) if name.startswith("op11") else rows
    assert queries.QUERIES[name](spark, sf_dir).count() == want.count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in found.description]
    made = queries.QUERIES[name](spark, sf_dir)
    assert sorted(made.columns) == sorted(columns)
    assert Counter(tuple(r[c] for c in columns) for r in made.collect()) == Counter(map(tuple, found.fetchall()))


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = common.materialise(stage(spark, now, sf_dir), name)
        assert now.columns == docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    groups = components_of({i: shingles(t) for i, t in texts.items()})
    expected = {i for i, t in texts.items() if groups[i] == i and not contaminated(t, items)[4]}
    assert {r.doc_id for r in now.collect()} == expected
    own = Tokenizer.from_file(TOKENS)
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(out) == expected
    for r in now.collect():
        assert out[r.doc_id].token_ids == own.encode(r.text or "", add_special_tokens=False).ids
        assert not base_spans(r.text)
