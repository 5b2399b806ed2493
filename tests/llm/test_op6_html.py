import math
import random
import time
from collections import Counter

from locusloom.llm.htmltext import GAMMA, Page, main_text, style_importance

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p {}</style></head><body>
<header class="site-header"><h1>Site</h1><nav><a href="/">Home</a></nav></header>
<div class="cookie-banner">We use cookies</div>
<main><article><h1>Head &amp; line {n}</h1><p>First <b>bold</b>
 paragraph {n}&nbsp;x.<p>Second &lt;b&gt; para.</p><script>var x = "<p>no</p>";</script><ul><li>one<li>two</ul><aside>Ad</aside><div class="share-buttons">Share</div></article></main>
<section id="comments"><p>reader says {n}</p></section><form><input><button>Go</button></form><footer>Foot</footer></body></html>"""


def run(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "1 as low", "'y' as text", "2 as n_chars")
    return {r.page_id: r for r in main_text(df).collect()}


def test_article_only(spark):
    got = run(spark, [(i, f"http://a.org/{i}", PAGE.replace("{n}", str(i))) for i in range(20)])
    for i in range(20):
        assert got[i].text == f"Head & line {i}\nFirst bold paragraph {i} x.\nSecond <b> para.\none\ntwo"
        assert got[i].n_chars == len(got[i].text) and got[i].url == f"http://a.org/{i}"


def test_site_furniture_without_names(spark):
    """Blocks that are the same on all pages of a host go although nothing names them."""
    body = "<html><body><div class='x1'>Same on every page of the site</div><div class='x2'><p>Own text {n} of this page, longer than the rest of it.</p><p>More words {n}.</p></div><div class='x3'>Imprint address</div></body></html>"
    got = run(spark, [(i, f"http://b.org/{i}", body.replace("{n}", str(i * 7))) for i in range(30)])
    assert got[3].text == "Own text 21 of this page, longer than the rest of it.\nMore words 21."


def test_copied_articles_keep_their_text(spark):
    page = "<html><body><nav>menu</nav><article><p>The same article everywhere.</p></article></body></html>"
    got = run(spark, [(i, f"http://c.org/{i}", page) for i in range(12)])
    assert all(r.text == "The same article everywhere." for r in got.values())


def test_degenerate_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "u", "no markup & all"), (4, "u", "<p>open <!-- never closed"), (5, "u", "<script>never closed"), (6, "u", "</div><p>x</p></b>"), (7, "u", "<p>" + "long " * 50_000), (7, "u", "<p>again"), (8, "u", "a < b and <p>c > d")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in main_text(df).collect())
    text = {i: t for i, t, _ in got}
    assert len(got) == 9 and text[1] == text[2] == text[5] == "" and text[3] == "no markup & all" and text[4] == "open" and text[6] == "x"
    assert all(len(t) == n for _, t, n in got)
    assert main_text(df.limit(0)).count() == 0


def test_copied_pages_keep_their_text(spark):
    """Copies of one page say nothing about what is furniture, whether or not an article is marked."""
    plain = "<html><body><p>First of three.</p><p>Second, a longer paragraph.</p><p>Third of them.</p></body></html>"
    marked = "<html><body><article><section class='a'>One part.</section><div class='b'>Another part.</div><div class='c'>The last part.</div></article></body></html>"
    got = run(spark, [(i, f"http://d.org/{i}", plain) for i in range(60)] + [(100 + i, f"http://e.org/{i}", marked) for i in range(20)])
    assert {r.text for i, r in got.items() if i < 100} == {"First of three.\nSecond, a longer paragraph.\nThird of them."}
    assert {r.text for i, r in got.items() if i >= 100} == {"One part.\nAnother part.\nThe last part."}


def test_entropy_never_takes_all_text(spark):
    """Pages that differ only in markup, not in text."""
    page = "<html><body><p>First of three.</p><p>Second, a longer paragraph.</p><p>Third of them.</p><!-- {n} --></body></html>"
    got = run(spark, [(i, f"http://f.org/{i}", page.replace("{n}", str(i))) for i in range(60)])
    assert {r.text for r in got.values()} == {"First of three.\nSecond, a longer paragraph.\nThird of them."}


def brute_force(pages):
    """Redundancy of each branch of each host, from the definition: {(host, path): redundancy}, and each host's main node."""
    hosts = {}
    for host, source in pages:
        page = Page(source)
        texts = page.texts()
        hosts.setdefault(host, {})[tuple(sorted((p, tuple(sorted(t))) for p, t in texts.items()))] = (texts, page.kinds())
    out, main = {}, {}
    for host, distinct in hosts.items():
        m = len(distinct)
        on, lines, kinds, entries = Counter(), {}, {}, {}
        for texts, shape in distinct.values():
            for path, (line, kind) in shape.items():
                lines[path] = line
                kinds.setdefault(path, []).append(kind)
            for path, found in texts.items():
                on.update((path, t) for t in set(found))
                entries.setdefault(path, []).extend(found)

        def redundancy(paths):
            found = [(len(t), math.log(on[p, t]) / math.log(m) if m > 1 else 0.0) for p in paths for t in entries.get(p, [])]
            return sum(c * h for c, h in found) / sum(c for c, _ in found) * len(found) / (len(found) + 2) if found else None

        for path in lines:
            r = redundancy([p for p in lines if path in lines[p]])
            if r is None:
                continue
            count = Counter(kinds[path])
            n = sum(count.values())
            varied = -sum(c / n * math.log(c / n) for c in count.values()) / math.log(n) if n > 1 else 0.0
            out[host, path] = r * (1 - (1 - GAMMA) * varied)
        main[host] = redundancy([max((sum(map(len, t)) * (1 - redundancy([p])), p) for p, t in entries.items() if p)[1]])
    return out, main


def test_importance_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        body = f"<nav><ul>{''.join(f'<li><a>{rng.choice("abcd")}</a></li>' for _ in range(rng.randint(1, 4)))}</ul></nav>"
        body += f"<div>{rng.choice(['same ad', 'other ad', f'ad {i}'])}</div><div><h1>Title {i % 20}</h1>{''.join(f'<p>words {rng.randint(0, 200)}</p>' for _ in range(rng.randint(0, 4)))}</div>"
        rows += [(i, f"http://h{i % 3}.org/{i}", body)] * rng.randint(1, 2)
    found = style_importance(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want, main = brute_force([(f"h{i % 3}.org", s) for i, _, s in rows])
    got = {(r.host, r.path % (1 << 64)): r.redundancy for r in found}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert all(abs(r.main - main[r.host]) < 1e-9 and abs(r.importance + r.redundancy - 1) < 1e-12 for r in found)


def test_tree_decides_without_names(spark):
    """Menus and footers that only come back now and then are less important than the text; unique ones aren't."""
    rng = random.Random(3)
    rows = []
    for i in range(120):
        say = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(n))
        kind = rng.randint(0, 30)
        rows.append((i, f"http://g.org/{i}", f"<div class='q1'>menu {kind}</div><div class='q2'><p>{say(40)}</p><p>{say(30)}</p></div><div class='q3'>{say(12)}</div><div class='q4'>bottom {kind}</div>"))
    got = run(spark, rows)
    assert all(len(r.text.split("\n")) == 3 and "menu" not in r.text and "bottom" not in r.text and r.n_low == 2 and r.n_named == 0 for r in got.values())


def test_classes_that_say_more_than_furniture_stay(spark):
    body = "<article><div class='related-work'><p>real {n}</p></div><div class='search-methods'>found {n}</div><div class='no-sidebar'><p>text {n}</p></div><div class='site-notice'>gone {n}</div><div class='ad-slot-3'>gone {n}</div><div id='comments' class='thread'>gone {n}</div><div data-class='ad' title='class=ad'>kept {n}</div></article>"
    got = run(spark, [(i, f"http://k.org/{i}", body.replace("{n}", str(i))) for i in range(30)])
    assert all(r.text == f"real {i}\nfound {i}\ntext {i}\nkept {i}" and r.n_named == 3 for i, r in got.items())


def test_hostile_markup_takes_linear_time():
    for source in ("<a " * 10**6, '<a "' * 300_001 + ">", "<div>" * 100_000 + "x", "<p><select>" + "<address>" * 100_000, "<b>" * 100_000 + "</i>" * 100_000, "<!" * 500_000, "<x y='" + ">" * 500_000, "<li>" * 100_000):
        began = time.process_time()
        page = Page(source)
        page.texts(), page.kinds(), page.text()
        assert time.process_time() - began < 10, source[:20]


def test_broken_tags(spark):
    assert Page("a <b title='x > y'>c</b> <i x=\"open>d").text()[0] == "a c d"
    assert Page("1 < 2 <p class=ad>no<p>yes <u").text()[0] == "1 < 2\nyes <u"
