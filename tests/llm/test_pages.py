import html as references
import random
import re

from tallyforge.llm import pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="news"><nav><ul><li><a href="/x">menu</a></ul></nav><header>head</header><div id="cookie-notice">we use cookies</div>
<div class="ad top">buy</div><article><header><h1>Title &amp; more</h1></header><p>One <b>two</b>&nbsp;
three<br>four<p>five &lt;six&gt;<!-- no --><aside>side</aside><div class='related-posts'>more</div><form>f<input name=q></form></article>
<section class="comments"><p>reader says</p></section><footer>&copy; foot</footer></body>"""


def test_blocks_of_a_marked_page():
    lines, zones, marked = pages.blocks(PAGE)
    assert [x for x, zone in zip(lines, zones) if zone == pages.MAIN] == ["Title & more", "One two three four", "five <six>"]
    assert marked and pages.UNMARKED not in zones and {"menu", "head", "we use cookies", "buy", "side", "more", "reader says"} < set(lines)


def slow_article(source):
    """The synthetic pages' article: between its tags, cut at block tags."""
    body = re.search(r"<article>(.*?)(</article>|\Z)", source, re.DOTALL)[1]
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", body.replace("<br>", " ")))
    return "\n\n".join(t for p in parts if (t := " ".join(references.unescape(p).split())))


def test_query_gives_the_articles(spark, data):
    table = {r.page_id: r for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    rows = pages.op10(spark, data).collect()
    assert sorted(r.page_id for r in rows) == sorted(table)
    for r in rows:
        assert r.text == slow_article(table[r.page_id].html) and r.url == table[r.page_id].url and r.n_chars == len(r.text)


def slow_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_equals_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        places, at = pages.common(a, b), 0
        assert len(places) == slow_common(a, b) and places == sorted(set(places))
        for i in places:  # a subsequence of b
            at = b.index(a[i], at) + 1


def test_common_in_runs_of_rows(monkeypatch):
    monkeypatch.setattr(pages, "HELD_BITS", 60)
    test_common_equals_brute_force()


def test_common_of_long_pages_of_repeated_lines():
    """40,000 lines that alternate or nearly so take linear space."""
    n = 40_000
    a = [f"line {i % 2}" for i in range(n)]
    b = [f"line {(i + i // 7) % 2}" if i % 5 else f"own {i}" for i in range(n)]
    places = pages.common(a, b)
    at = 0
    for i in places[:2000]:
        at = b.index(a[i], at) + 1
    assert len(places) > n // 2


def test_pages_without_an_article_are_differenced(spark):
    def page(body):
        return f"<body><div>Site name</div><div>Our slogan</div>{body}<div>All rights reserved</div>"

    rows = [(i, f"http://h.example/a/{i}?x=1", page(f"<p>story {i}<p>more of {i}<p>end {i}")) for i in range(600)]
    rows += [(1000, "http://h.example/a/5", rows[5][2]), (1001, "http://lone.example/z", page("<p>only")), (1002, None, page("x")), (1003, "http://h.example/e", None), (1004, "", "")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    found = {r.page_id: r.text for r in pages.main_texts(frame).collect()}
    assert len(found) == len(rows) and found[1003] == found[1004] == ""
    assert found[1001] == "Site name\n\nOur slogan\n\nonly\n\nAll rights reserved"
    assert all(found[i] == f"story {i}\n\nmore of {i}\n\nend {i}" for i in range(600)) and found[1000] == found[5]
    assert pages.main_texts(frame.where("false")).count() == 0


def as_page(path, lines, zones):
    return pages.Page(path, list(lines), [0 if zone == pages.BOILER else len(x) for x, zone in zip(lines, zones)])


def difference(rows):
    """Places of shared lines of the rows (path, lines, zones) of one host, by the definition: the
    pages around a page's run, or the ends of the run that is the whole host."""
    found = [as_page(*row) for row in rows]
    order = sorted((n for n, page in enumerate(found) if any(page.weights)), key=lambda n: found[n].path)
    runs = []
    for n in order:
        if runs and pages.compare(found[n], found[runs[-1][-1]])[0] >= pages.COPY:
            runs[-1].append(n)
        else:
            runs.append([n])
    out = [set() for _ in rows]
    for at, run in enumerate(runs):
        before = found[runs[at - 1][-1]] if at else None
        after = found[runs[at + 1][0]] if at + 1 < len(runs) else None
        if len(runs) == 1:
            before, after = found[run[0]], found[run[-1]]
        for n in run:
            out[n] = set(pages.shared_lines(found[n], before, after))
    return out


def lines_in_common(a, b):
    """Places in a of the longest common subsequence, by the table of lengths."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    found, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            found, i, j = [*found, i], i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            i += 1
        else:
            j += 1
    return found


def slow_texts(rows):
    """page_id -> text for rows (page_id, url, lines) without zones, from the whole host lists."""
    hosts = {}
    for page_id, url, lines in rows:
        path = url.split("://")[1]
        hosts.setdefault(path.split("/")[0], {}).setdefault((path, tuple(lines)), []).append(page_id)

    def alike(a, b):
        shared = lines_in_common(a, b)
        total, least = sum(len(a[n]) for n in shared), min(sum(map(len, a)), sum(map(len, b)))
        return total / least, total / least >= 0.8 and least - total <= 40, set(shared)

    def prefix(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    texts = {}
    for found in hosts.values():
        order = sorted(found)
        starts = [0, *(n for n in range(1, len(order)) if alike(order[n][1], order[n - 1][1])[0] < 0.8), len(order)]
        for first, end in zip(starts, starts[1:]):
            for path, lines in order[first:end]:
                near = [order[k] for k in (first - 1, end) if 0 <= k < len(order)] or [order[first], order[end - 1]]
                near = [x for x in near if x[1] != lines]
                gone = set()
                if near:
                    sides = [(alike(lines, x[1]), x) for x in near]
                    (_, copy, same), _ = min(sides, key=lambda s: (s[0][0] if s[0][0] >= 0.8 else 0, -prefix(path, s[1][0])))
                    if not copy:
                        gone = same
                    elif len(near) == 2 and sides[0][0][1] and sides[1][0][1] and not alike(near[0][1], near[1][1])[1]:
                        gone = sides[0][0][2] & sides[1][0][2]
                for page_id in found[path, lines]:
                    texts[page_id] = "\n\n".join(x for n, x in enumerate(lines) if n not in gone)
    return texts


def frame_of(spark, rows):
    return spark.createDataFrame([(i, url, "".join(f"<p>{x}" for x in lines)) for i, url, lines in rows], "page_id long, url string, html string")


def odd_hosts():
    """Hosts of runs of copies and near copies, of long templates, and of pages of their own."""
    rng = random.Random(10)
    site = ["Name of the site", "Its slogan"], ["All rights reserved"]
    long = [f"template line {i} that every page of the site carries" for i in range(12)]
    rows = []
    for host in range(12):
        for run in range(rng.randint(1, 8)):
            top, foot = (long, []) if rng.random() < 0.3 else site
            story = [f"part {n} of story {host} {run}" + " told at length" * rng.randint(0, 3) for n in range(rng.randint(1, 9))]
            for n in range(rng.choice((1, 1, 2, 7, 25))):
                own = rng.choice(([], [f"seen {n}"], [f"edition {n} " + "edited by hand " * 4 + str(n)]))
                rows.append((len(rows), f"http://h{host}.example/{run}/{n:03}", [*top, *story, *own, *foot]))
    return rows + [(len(rows) + k, url, lines) for k, (_, url, lines) in enumerate(rng.choices(rows, k=60))]


def test_texts_equal_brute_force_whatever_the_ranges(spark):
    rows = odd_hosts()
    wanted = slow_texts(rows)
    frame = frame_of(spark, rows)
    for n_ranges, most_held in ((None, pages.HELD_LINES), (1, 20), (4, 50), (64, pages.HELD_LINES), (211, 1)):
        found = {r.page_id: r.text for r in pages.main_texts(frame, n_ranges, most_held).collect()}
        assert found == wanted, (n_ranges, most_held, [k for k in wanted if found.get(k) != wanted[k]][:5])


def test_hosts_of_copies_lose_their_template_whatever_the_ranges(spark):
    """One host of copies of one story but one page, one of many equal rows, one of near copies."""
    story = [f"part {i} of a story crawled again and again" for i in range(12)]
    ends = lambda lines: ["Name of the site", *lines, "All rights reserved"]
    rows = [(i, f"http://big.example/{i:05}", ends(story if i != 500 else ["Another story, told at some length"])) for i in range(1000)]
    rows += [(2000 + i, f"http://near.example/{i:05}", ends([*story, f"seen {i}"])) for i in range(600)] + [(2999, "http://near.example/z", ends(["Told elsewhere"]))]
    rows += [(3000 + i, "http://same.example/x", ends(["Equal rows"])) for i in range(2000)] + [(6000, "http://same.example/y", ends(["Its neighbour"]))]
    for n_ranges in (4, 64):
        found = {r.page_id: r.text for r in pages.main_texts(frame_of(spark, rows), n_ranges, 2000).collect()}
        assert found == {i: "\n\n".join(lines[1:-1]) for i, _, lines in rows}
    # Equal rows are one class, so no range holds them all.
    assert pages.classes(frame_of(spark, rows)).where("host = 'same.example'").orderBy("n").collect()[1].n == 2000


def test_lines_shared_by_marked_articles_stay():
    def page(i):
        return ("h/a", *pages.blocks(f"<nav>go {i}</nav><p>Site</p><article><p>Quoted by both<p>own text number {i} of this page</article><p>outside")[:2])

    rows = [page(1), page(2)]
    shared = difference(rows)
    assert [[rows[k][1][n] for n in sorted(shared[k])] for k in (0, 1)] == [["Site", "Quoted by both", "outside"]] * 2
    assert pages.article(*rows[0][1:], True, shared[0]) == "Quoted by both\n\nown text number 1 of this page"


def test_odd_markup():
    assert pages.blocks("a < b <3 <p class=\"x>y\">c</p> <script>unclosed") == (["a < b <3", "c"], [pages.UNMARKED] * 2, False)
    assert pages.blocks("<article>" * 3000 + "x")[0] == ["x"]
    assert pages.blocks("<a " + "\"'" * 5000)[0] in ([], ["<a " + "\"'" * 5000])


def page_lines(path, *lines):
    return path, list(lines), [pages.UNMARKED] * len(lines)


def left_lines(rows):
    return [[x for n, x in enumerate(row[1]) if n not in gone] for row, gone in zip(rows, difference(rows))]


TEMPLATE = [f"template line {i} that every page of the site carries" for i in range(30)]


def test_a_long_template_goes_from_short_stories():
    stories = [f"story {i}: " + f"what happened on day {i} " * 4 for i in range(12)]
    assert left_lines([page_lines(f"h/{i:02}", *TEMPLATE, x) for i, x in enumerate(stories)]) == [[x] for x in stories]


def test_a_page_of_the_template_alone_is_left_empty():
    stories = [f"story {i}: " + f"what happened on day {i} " * 4 for i in range(3)]
    rows = [page_lines(f"h/{i}", *TEMPLATE, *([stories[i]] if i != 1 else [])) for i in range(3)]
    assert left_lines(rows) == [[stories[0]], [], [stories[2]]]


def test_runs_of_copies_are_walked_past():
    story = [f"part {i} of a story crawled again and again" for i in range(30)]
    rows = [page_lines("h/a", *TEMPLATE[:4], "another text " * 9)]
    rows += [page_lines("h/b", *TEMPLATE[:4], *story, f"seen {i}") for i in range(500)]
    rows += [page_lines("h/c", *TEMPLATE[:4], *story)] * 500
    found = left_lines(rows)
    assert found[0] == ["another text " * 9] and all(x[:30] == story and len(x) <= 31 for x in found[1:])
    alone = rows[1:]
    assert left_lines(alone) == [row[1] for row in alone]


def test_the_nearest_url_is_the_partner(spark):
    """Sections of two pages each: the nearest URL is the only page that shares the section's line."""
    rows = [(i, f"http://big.example/{i // 2:04}/{i % 2}", ["Site", f"Section {i // 2}", f"story {i} as told on its own page", f"more of {i}"]) for i in range(1200)]
    rows += [(5000 + i, f"http://run.example/a/{i:04}", ["Site", "Section 1", "story 1 as told on its own page", "more of 1"]) for i in range(700)]
    rows += [(9000, "http://run.example/b", ["Site", "Section 1", "story 2 as told on its own page", "more of 2"])]
    found = {r.page_id: r.text for r in pages.main_texts(frame_of(spark, rows), 32).collect()}
    assert found == {i: "\n\n".join(lines[2:]) for i, _, lines in rows}


def test_a_teaser_is_no_article_and_sections_keep_their_names():
    story = "<p>The story stands outside of any article element.<p>It is long."
    for teaser in ("<article><p>Read this too</article>", "<main></main>"):
        lines, zones, marked = pages.blocks(f"<nav>go</nav>{teaser}<div>{story}</div>")
        assert not marked and pages.MAIN not in zones and zones[0] == pages.BOILER
        assert "The story stands outside of any article element." in pages.article(lines, zones, marked, set())
    inside = '<h2 id="related">Related work</h2><section id="discussion"><p>We discuss</section>'
    lines, zones, marked = pages.blocks(f'<article><p>One{inside}<section class="comments">says</section></article><section id="comments">x</section>')
    assert pages.article(lines, zones, marked, set()) == "One\n\nRelated work\n\nWe discuss"
