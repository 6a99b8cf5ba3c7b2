"""Personal data, toxicity, fingerprints, HTML and quality rules."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import AWKWARD, sentence
from tidemark.llm import fingerprints, html_text, pii, quality, toxicity

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {
        "email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")),
        "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15,
    }[kind]


def brute_pii(text):
    found = [
        (m.start(), k, m.end()) for k, kind in enumerate(BASE) for m in re.finditer(BASE[kind], text or "") if passes(kind, m[0])
    ]
    return [(list(BASE)[k], a, b) for a, k, b in sorted(found)]


TEXTS = [
    "mail a.b%c@x-y.co.uk, or é@ü.de a@b.c_d@e.f @x.y a@b",
    "1.2.3.4.5.6.7.8 256.1.1.1 0255.01.1.1 999.1.2.3.4.5 1.2.3.99999999999999999999",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 7536784127813050 4845168114407329 4111111111111111",
    "+1 (017) 555-7713 +1 (017) 555-7713 4111111111111111 +123 ++49 30 1234567. +4 5-",
    "\U0001f600\U0001f600 éè q@r.st \U0001f600 10.0.0.1",
    "a." * 3000 + "@" + "b." * 3000 + "c " + "9" * 4000 + " " + "1.1." * 2000 + "1",
    "".join(random.Random(7).choices("12.-+ @a()", k=4000)),
    "".join(random.Random(8).choices("0123456789 .-+", k=4000)),
]


def test_base_spans_equal_brute_force(docs):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(90, None), (91, "")]
    for r in pii.find_pii(docs(rows), pii.PiiModel()).collect():
        want = brute_pii(dict(rows)[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.spans == joined and r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[0] == k for w in want) for k in BASE]


def test_base_spans_in_groups_of_two_digits(docs):
    texts = ["call +33 6 12 34 56 78 now", "+33-6-12-34-56-78", "41 11 11 11 11 11 11 11", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "+33 6 12 34 and 12 34", "none"]
    for r in pii.find_pii(docs(list(enumerate(texts))), pii.PiiModel()).collect():
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_pii(texts[r.doc_id]))
        assert bool(joined) == (r.doc_id < 4)
        assert r.spans == joined and r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
    clean = pii.redact(docs(list(enumerate(texts))), pii.PiiModel()).where("doc_id = 0").first()
    assert clean.text == "call [PHONE] now"


def card(rng):
    head = "".join(rng.choices("123456789", k=15))
    return next(head + c for c in "0123456789" if luhn(head + c))


def test_trees_add_what_a_greedy_match_swallows(docs):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        bad = card(rng)
        bad = bad[:-1] + str((int(bad[-1]) + 1) % 10)
        rows.append((i, f"{sentence(5, i)}: {card(rng)}, {sentence(3, i)} id {bad}. mail u{i}@mail.example.com"))
    two = [card(rng), card(rng)]
    table = docs([*rows, (1000, f"pay {two[0]} {two[1]} now")])
    model = pii.fit_pii(table, precision=0.95)
    assert model.thresholds["card"] is not None
    found = {r.doc_id: r for r in pii.find_pii(table, model).collect()}
    assert found[1000].spans == "card:4:20,card:21:37" and found[1000].n_card == 0
    assert all(found[i].spans == ",".join(f"{k}:{a}:{b}" for k, a, b in brute_pii(t)) for i, t in rows)


def test_a_rare_kind_is_fitted_and_calibrated_on_all_its_candidates(docs):
    rng = random.Random(2)
    rows = [(i, "".join(f"u{i}x{j}@mail{'.example.com' if j % 2 else ''} " for j in range(60))) for i in range(200)]
    rows += [(1000 + i, f"ip {rng.randrange(256)}.2.3.{rng.randrange(256)}, no {rng.randrange(300, 999)}.2.3.4;") for i in range(100)]
    model = pii.fit_pii(docs(rows), max_candidates=600)
    assert model.thresholds["ip"] is not None and model.thresholds["email"] is not None


def test_spelled_addresses_and_national_phones_are_found(docs):
    rng = random.Random(3)
    phone = lambda: f"{rng.randrange(200, 999)}-555-{rng.randrange(1000, 9999)}"
    rows = [(i, f"{sentence(4, i)} mail u{i} [at] host{i % 7} [dot] org, or call {phone()} soon, part #{phone()}/x") for i in range(400)]
    found = {r.doc_id: r for r in pii.find_pii(docs(rows), pii.fit_pii(docs(rows), precision=0.95)).collect()}
    for i, t in rows:
        mail, call = f"u{i} [at] host{i % 7} [dot] org", re.search(r"call (\S+)", t)
        assert found[i].spans == f"email:{t.index(mail)}:{t.index(mail) + len(mail)},phone:{call.start(1)}:{call.end(1)}"
        assert found[i].n_email == found[i].n_phone == 0


def test_redaction(docs):
    rows = [(1, "x a@b.co y 10.0.0.1"), (2, None), (3, "nothing here"), (4, "\U0001f600a@b.co")]
    table = docs(rows)
    out = pii.redact(table, pii.PiiModel())
    assert out.columns == table.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {
        1: ("x [EMAIL] y [IP]", 16), 2: (None, 0), 3: ("nothing here", 12), 4: ("\U0001f600[EMAIL]", 8),
    }
    assert pii.find_pii(docs([]), pii.fit_pii(docs([]))).collect() == []
    assert len(pii.find_pii(docs(AWKWARD), pii.fit_pii(docs(AWKWARD))).collect()) == len(AWKWARD)


def brute_added(base, chosen):
    """All free spans that no better free one meets, by comparing each with each."""
    over = lambda a, b: a[0] < b[2] and b[0] < a[2]
    rank = lambda c: (c[3], c[2] - c[0], -c[0], -c[1])
    free = [c for s in chosen for c in s if not any(over(c, b) for t in base for b in t)]
    return sorted(c[:3] for c in free if not any(over(c, d) and rank(d) > rank(c) for d in free))


def test_added_spans_equal_comparing_all(spark):
    rng, rows = random.Random(4), []

    def stream(kind, n, long, scored):
        at, out = 0, []
        for _ in range(n):
            at += rng.randrange(long)
            end = at + rng.randrange(1, long)
            out.append((at, kind, end, float(rng.randrange(4))) if scored else (at, kind, end))
            at = end
        return out

    for i in range(60):
        base = [stream(k, rng.randrange(3), 30, False) for k in range(4)]
        chosen = [stream(k % 4, rng.randrange(12), rng.choice([6, 15, 60]), True) for k in range(7)]
        rows.append((i, base, chosen))
    table = spark.createDataFrame(rows, f"i int, base array<{pii.SPANS.replace(',match:string', '')}>, chosen array<{pii.SCORED}>")
    found = table.select("i", pii.added(F.col("base"), F.col("chosen")).alias("got")).collect()
    assert sum(len(r.got) for r in found) > 100
    for r in found:
        assert sorted(map(tuple, r.got)) == brute_added(*rows[r.i][1:])


def test_spans_of_very_long_texts(docs):
    """Ten thousand addresses in one text, a long run of digits, and a token that holds most of its text."""
    many = "".join(f"\U0001f600 u{i}@mail.example.com, 10.0.{i % 256}.7; +33 6 12 34 56 78 " for i in range(3000))
    rows = [(1, many), (2, "1 " * 100_000), (3, "a@" + "b.cc" * 50_000), (4, "x@" + "415-555-0123@" * 5000), (5, "é" * 700 + "a@b.co" + " " * 700 + "1.2.3.4")]
    rows += [(10 + i, f"mail u{i}@mail.example.com, no {i % 256}.2.3.{i} and v{i}@x") for i in range(300)]
    table = docs(rows)
    model = pii.fit_pii(table, precision=0.9)
    spans = {r.doc_id: r for r in pii.find_pii(table, model).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(table, model).collect()}
    for i, text in rows:
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_pii(text))
        assert spans[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        out, at = [], 0
        for kind, a, b in (x.split(":") for x in spans[i].spans.split(",") if x):
            if int(a) >= at:
                out += [text[at : int(a)], f"[{kind.upper()}]"]
            at = max(at, int(b))
        assert clean[i] == "".join(out) + text[at:]
    assert spans[1].n_email == spans[1].n_ip == spans[1].n_phone == 3000


def labelled(spark, n=600, biased=False):
    """Toxic texts hold one of three words; if biased, a third of them only a term of a group."""
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = sentence(40, i).split()
        if biased and i % 12 == 0:
            words[3] = "gay"
        elif toxic:
            words[i % 40] = ("Vileword!", "nastyword", "(grimword)")[i % 3]
        if i % 7 == 0:
            words[(i + 5) % 40] = "gay" if toxic else "straight"
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, spark.createDataFrame([*labels, (10**6, 1), (None, 1), (5, None)], "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark, docs):
    rows, labels = labelled(spark)
    table = docs(rows)
    model = toxicity.fit_toxicity(table, labels)
    out = toxicity.score_toxicity(table, model).collect()
    held = [r for r in out if r.held_out]
    assert 60 < len(held) < 200 and all(r.predicted == (r.score >= 0.5) for r in out)
    right = sum(r.predicted == (r.doc_id % 4 == 0) for r in held)
    assert right >= 0.97 * len(held)
    clean = toxicity.drop_toxic(table, model)
    assert clean.columns == table.columns and clean.where("doc_id % 4 = 0").count() < 10


def test_swapping_a_term_moves_the_score_less_with_the_penalty(spark, docs):
    rows, labels = labelled(spark, biased=True)
    table = docs(rows)
    pair = docs([(1, "gay people met"), (2, "straight people met")])
    gaps = []
    for penalty in (0.0, 50.0):
        model = toxicity.fit_toxicity(table, labels, swap_penalty=penalty, l1=1e-5)
        a, b = (r.score for r in toxicity.score_toxicity(pair, model).orderBy("doc_id").collect())
        gaps.append(abs(a - b))
    assert gaps[1] < gaps[0] / 2


def test_toxicity_without_labels_and_awkward_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs(AWKWARD), none)
    out = toxicity.score_toxicity(docs(AWKWARD), model).collect()
    assert len(out) == len(AWKWARD) and all(0 <= r.score < 0.01 for r in out)
    one = spark.createDataFrame([(5, 1), (7, 1)], "doc_id long, toxic int")
    assert toxicity.fit_toxicity(docs(AWKWARD), one).bias > 5
    assert toxicity.score_toxicity(docs([]), model).collect() == []


def test_prefix_hashes_answer_spans_and_extensions():
    rng = random.Random(4)
    a, b = ("".join(rng.choices("ab\U0001f600", k=300)) for _ in range(2))
    b = b[:50] + a[20:200] + b[50:]
    x, y = fingerprints.Prefixes(a), fingerprints.Prefixes(b)
    for _ in range(300):
        i, j = rng.randrange(300), rng.randrange(len(b))
        n = 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        assert x.common_extension(i, y, j) == n
    assert x.common_extension(20, y, 50) >= 180


def test_fingerprints_of_next_and_edited_texts(docs):
    texts = {i: sentence(30 + i % 50, i) for i in range(57)} | {60: None, 61: "", 62: "a", 63: sentence(40, 3)}
    texts[70] = texts[63]
    order = sorted(texts, reverse=True)
    how = fingerprints.Fingerprinting(rows_per_range=8)
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs(list(texts.items())), how).collect()}
    assert len(got) == len(texts)
    for k, i in enumerate(order):
        text, following = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert r.fingerprint == fingerprints.fingerprint(text, how)[0]
        assert r.edited_fingerprint == fingerprints.fingerprint(changed, how)[0]
        assert 0 <= r.near_next <= 1 and (r.near_next == 1) == (text == following) and (r.near_edited == 1) == (changed == text)
    assert got[70].fingerprint == got[63].fingerprint


def test_shared_spans_and_seams(docs):
    shared = sentence(60, 9)
    texts = {1: "alone", 2: "x" * 500 + shared + "y" * 400, 3: sentence(30, 4) + shared + sentence(300, 5), 4: "abc" * 9, 5: "ab" * 3}
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs(list(texts.items()))).collect()}
    assert len(shared) <= got[3].shared_next <= len(shared) + 1
    assert got[4].shared_next == got[2].shared_next == 0
    for n, more in ((0, 5), (1, 5), (7, 0), (15, 3), (16, 2), (17, 99), (40, 1), (40, 40)):
        text, following = sentence(40, n)[:n], sentence(40, more)[:more]
        changed = text[: n - n // 2] + following[: n // 2]
        how = fingerprints.Fingerprinting()
        whole = fingerprints.edited_fingerprint(text, fingerprints.Prefixes(text), following, fingerprints.Prefixes(following), how)
        assert whole[0] == fingerprints.fingerprint(changed, how)[0]


def test_awkward_rows_of_fingerprints(docs):
    got = fingerprints.fingerprint_documents(docs(AWKWARD), fingerprints.Fingerprinting(rows_per_range=3)).collect()
    assert len(got) == len(AWKWARD)
    assert fingerprints.fingerprint_documents(docs([])).collect() == []
    alone = fingerprints.fingerprint_documents(docs([(1, "abcd")])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and alone.near_next == 1.0


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="<p>no</p>";</script></head><body class="menu-open">
<nav><ul><li>Home</ul></nav><header>Site</header><div class="ad-box">buy</div><form><p>name <input></form>
<article><header><h1>A &amp; B</h1></header><p>One <b>two<br>three <p>four&nbsp;five <!-- x --> <ul><li>i<li>ii</ul>
<aside>side</aside><div class="related-posts">more</div><div class="leading">end</div></article>
<section id="comments"><p>I agree</p></section><footer>&copy;</footer></body></html>"""


def test_main_text_of_a_page():
    assert html_text.main_text(PAGE).split("\n\n") == ["A & B", "One two three", "four five", "i", "ii", "end"]
    for page, text in [
        ("", ""), ("plain < text & more", "plain < text & more"), ("<p>a<p>b</div>c", "a\n\nbc"), ("<script>x", ""),
        ("<main><p>m</main><p>o", "m"), ("<p>a<b>b</b>c", "abc"), ("<div><article>1</article></div><article>2", "1\n\n2"),
        ("<p>unclosed <a href='x>y'>l</a", "unclosed l"), ("<!-- never closed <p>x", ""),
    ]:
        assert html_text.main_text(page) == text, page
    deep = "<div>" * 5000 + "in" + "</div>" * 5000 + "<p>out"
    assert html_text.main_text(deep) == "in\n\nout" and len(html_text.digests(html_text.parse(deep))) == 5002
    assert html_text.main_text("<a href=\"" + "x" * 50_000) and html_text.main_text("<" * 50_000) == "<" * 50_000


def test_depth_has_no_limit():
    inner = "<nav><p>menu</p></nav><p>kept</p>"
    for depth in (198, 199, 500, 20_000):
        page = "<article>" + "<div>" * depth + inner + "</div>" * depth + "<p>after</article><p>outside"
        assert html_text.main_text(page) == "kept\n\nafter", depth
    wide = "<ul>" + "<li>x" * 50_000 + "</b>" * 50_000
    assert html_text.main_text("<div>" * 20_000 + wide).count("x") == 50_000


def test_marks_inside_an_article_are_whole_names():
    kept = ["social-history", "hidden-gem", "side", "notice", "related", "share-price", "menu-of-the-day"]
    page = "".join(f'<section class="{c}"><p>{c}</p></section>' for c in kept)
    article = f'<article>{page}<div class="ad">no</div><div id="comments">no</div><p class="x advertisement">no</p></article>'
    assert html_text.main_text(article).split("\n\n") == kept
    outside = '<div class="hidden-gem">a</div><div class="cookie-notice">no</div><div class="side">no</div><div class="ad-box">no</div><p>b'
    assert html_text.main_text(outside) == "a\n\nb"


def brute_templates(rows, how):
    """Per host the elements on enough pages of different text, found page by page."""
    by_host = {}
    for _, url, page in rows:
        root = html_text.parse(page or "")
        found = {}
        for digest, size, inside, linked in html_text.digests(root)[:-1]:
            if size >= how.characters or (size and linked and not inside):
                found[digest] = found.get(digest, True) and inside
        host = re.sub(r"^.*?//([^/]*).*", r"\1", url)
        by_host.setdefault(host, {}).setdefault(html_text.main_text(page or ""), []).append(found)
    out = {}
    for host, texts in by_host.items():
        pages, outer = Counter(), set()
        for found in texts.values():
            pages.update({d for f in found for d in f})
            outer |= {d for f in found for d, inside in f.items() if not inside}
        many = {d for d, n in pages.items() if n >= how.pages and n >= how.article_share * len(texts)}
        some = {d for d in outer - many if pages[d] >= how.pages and pages[d] >= how.share * len(texts)}
        if many or some:
            out[host] = (many, some)
    return out


@pytest.mark.parametrize("sent", [10**6, -1])
def test_templates_against_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(html_text, "SENT_DIGESTS", sent)
    rng = random.Random(5)
    rows = []
    for i in range(160):
        host = f"h{i % 3 if i % 2 else 0}.org"
        menu = "".join(f"<li><a href=x>{w}</a></li>" for w in rng.sample(["home", "news", "about us", "shop", "blog"], 3))
        quote = f"<p>{sentence(9, rng.randrange(8))}</p>"
        body = f"<p>{sentence(12, i % 140)}</p>{quote}<p>home</p>"
        body = f"<article>{body}</article>" if i % 5 else f"<div>{body}</div>"
        rows.append((i, f"https://{host}/{i}", f"<body><div><ul>{menu}</ul></div><p>Read all our terms here</p>{body}</body>"))
    how = html_text.Template(share=0.08)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    want = brute_templates(rows, how)
    got = html_text.site_templates(html_text.element_counts(pages, how), how).collect()
    assert {r.host: (set(r.anywhere), set(r.outside)) for r in got} == want and any(some for _, some in want.values())
    for r in html_text.extract_text(pages, how).collect():
        host = f"h{r.page_id % 3 if r.page_id % 2 else 0}.org"
        known = html_text.Templates(*map(frozenset, want.get(host, ((), ()))))
        assert r.text == html_text.main_text(rows[r.page_id][2], known)
        assert sentence(12, r.page_id % 140) in r.text and "home" in r.text and "terms" not in r.text


def test_site_parts_that_recur_are_dropped(spark):
    rows = [
        (i, f"https://a.org/{i}", f"<body><div><p>Join our club today please</p></div><p>{sentence(20, i)}</p><p>{'same short' if i < 3 else sentence(4, i)}</p>")
        for i in range(10)
    ]
    rows += [(20 + i, f"https://b.org/{i}", f"<body><p>{sentence(20, 7)}</p><i>{i}</i>") for i in range(2)]
    rows += [(40 + i, "https://c.org/x", f"<body><p>{sentence(20, 8)}</p>") for i in range(9)]
    rows += [(90, None, None), (91, "no host", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).repartition(4)
    out = {r.page_id: r for r in html_text.extract_text(pages).collect()}
    assert len(out) == len(rows)
    assert out[5].text == f"{sentence(20, 5)}\n\n{sentence(4, 5)}" and out[5].n_chars == len(out[5].text)
    assert out[0].text == f"{sentence(20, 0)}\n\nsame short"
    assert out[21].text.startswith(sentence(20, 7)) and out[45].text == sentence(20, 8)  # copies are no template
    assert out[90].text == out[91].text == ""
    assert html_text.extract_text(pages.limit(0)).collect() == []


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    n = Counter(grams)
    hit = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_and_base_rule(docs):
    texts = [sentence(30, 1), "a b c d e a b c d e f", "x\nx \nx\n\n \nx", "é# ü* <b>|&%$", None, "", "w " * 50, sentence(60, 2) + " " + sentence(6, 2)]
    for r in quality.judge_quality(docs(list(enumerate(texts)))).collect():
        want = brute_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_limits_follow_the_group(docs):
    plain = [(i, sentence(40, i), "en", "s0", 0) for i in range(300)]
    code = [(1000 + i, sentence(40, i).replace(" ", " #* "), "en", "s1", 0) for i in range(300)]
    odd = [(5000, sentence(40, 1).replace(" ", " #* "), "en", "s0", 0), (5001, sentence(40, 2), None, None, 0)]
    out = {r.doc_id: r.kept for r in quality.judge_quality(docs([*plain, *code, *odd])).collect()}
    assert all(out[i] for i in range(300)) and all(out[1000 + i] for i in range(300))
    assert not out[5000] and out[5001]


def test_sketches_merge_to_the_quantile(spark):
    values = [random.Random(k).expovariate(1) for k in range(4000)]
    rows = [("en", "s", 1000, int(1000 * v), 0, 1, 0, 0) for v in values]
    names = "lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
    limits = quality.Limits(group_rows=1)
    at = quality.thresholds(spark.createDataFrame(rows, names), limits).first().limits
    q = sorted(int(1000 * v) / 1000 for v in values)
    want = q[1999] + 6 * (q[2999] - q[1999])
    assert at.high_word_length == pytest.approx(want, rel=0.05)


def test_awkward_rows_of_quality(docs):
    assert len(quality.judge_quality(docs(AWKWARD)).collect()) == len(AWKWARD)
    assert quality.judge_quality(docs([])).collect() == []
