"""Near duplicates, nearest neighbours, page text and the pipeline, against brute force."""

import random
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import documents, empty, odd, words
from tokenizers import Tokenizer

import corpus_pipeline
from tickerloom.llm import common, mixing, nearest, neardup, quality, secrets, wrapper

SF = "/root/testdata/sf0.001"


def shingles(text, n):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1)))


def components(texts, n, percent):
    """By comparing every pair."""
    sets = {i: shingles(t, n) for i, t in texts}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def hard_texts():
    """A large group of near copies around a base, chains, and groups without a base."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    out = []
    for k in range(150):
        near = list(base)
        for at in rng.sample(range(120), rng.randint(0, 9)):
            near[at] = f"x{k}_{at}"
        out.append(" ".join(near))
    chain = [rng.choice(vocabulary) for _ in range(90)]
    for k in range(30):
        chain = chain[2:] + [f"c{k}a", f"c{k}b"]
        out.append(" ".join(chain))
    for group in range(15):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(1, 40))]
        out += [" ".join(text), " ".join(text).upper(), " ".join(text[:-1])]
    out += ["", " ", "one", "ONE", "one two", "one  two"]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, n, percent):
    texts = hard_texts()
    want, sizes = components(texts, n, percent)
    rows = neardup.components(documents(spark, [(i, t, None, None) for i, t in texts]), n, percent).collect()
    assert {r.doc_id: r.component_id for r in rows} == want and {r.doc_id: r.n_shingles for r in rows} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_small_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    texts = hard_texts()
    want, _ = components(texts, 3, 85)
    rows = neardup.components(documents(spark, [(i, t, None, None) for i, t in texts])).collect()
    assert {r.doc_id: r.component_id for r in rows} == want


def test_query_over_the_table(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want, _ = components(texts, 3, 85)
    assert {r.doc_id: r.component_id for r in neardup.op10_neardup(spark, SF).collect()} == want


def test_banding_keeps_the_chance_of_a_miss_small():
    assert neardup.banding(85) == (20, 6) and neardup.banding(80) == (24, 5)
    for percent in range(30, 101):
        bands, rows = neardup.banding(percent)
        assert bands * rows <= 2 * neardup.PERMUTATIONS and (1 - (percent / 100) ** rows) ** bands <= neardup.MISS


def test_sweep(spark):
    kept = common.staged(spark.range(3))
    assert kept.count() == 3
    common.sweep(spark)
    assert not common._stages and spark.range(1).count() == 1


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    values = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    x, y = np.sort(values[:2000]), np.sort(values[500:2500])
    sets = neardup.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
    assert (sets[0] == sets[1]).mean() == pytest.approx(1500 / 2500, abs=0.15)


def test_components_join_by_chains(spark):
    nodes = [bytes([k]) * 16 for k in range(40)]
    labels = spark.createDataFrame([(n, n) for n in nodes], "class binary, component binary")
    order = list(range(20))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame([(nodes[a], nodes[b]) for a, b in zip(order, order[1:], strict=False)] + [(nodes[30], nodes[31])], "a binary, b binary")
    got = {bytes(r["class"]): bytes(r.component) for r in neardup.connect(labels, edges).collect()}
    assert {got[nodes[k]] for k in range(20)} == {nodes[0]} and got[nodes[31]] == nodes[30] and got[nodes[35]] == nodes[35]


def test_near_duplicates_of_odd_rows(spark):
    docs = odd(spark)
    rows = neardup.components(docs).collect()
    assert len(rows) == 10
    by = Counter((r.doc_id, r.component_id, r.kept, r.n_shingles > 0) for r in rows)
    assert by[(4, 4, True, True)] == 2 and by[(None, None, True, True)] == 1 and by[(2, 2, True, False)] == 1
    assert neardup.components(empty(spark)).count() == 0
    kept = neardup.deduplicate(docs)
    # The three rows of one text leave one; null, empty and blank texts all stay.
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "7", "8"]
    assert neardup.deduplicate(empty(spark)).count() == 0
    two = documents(spark, [(1, "a b c d e f g h", None, None), (1, "other words here now and then again", None, None), (2, "a b c d e f g h", None, None)])
    assert sorted((r.doc_id, r.component_id) for r in neardup.components(two).collect()) == [(1, 1), (1, 1), (2, 1)]


def test_deduplicate_goes_by_row_not_by_id(spark):
    a, b, c, d = ("one two three four five six seven eight nine", "quite another text with words of its own here", "a third one that is not like them at all", "the fourth of these texts stands alone too")
    docs = documents(spark, [(1, a, None, None), (1, b, None, None), (2, b, None, None), (0, b, "x", None), (None, c, None, None), (None, d, None, None), (3, c, None, None)])
    kept = neardup.deduplicate(docs)
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("1", a), ("0", b), ("3", c), ("None", d)])
    same = documents(spark, [(7, a, "l", "s")] * 50 + [(8, None, None, None)] * 3)
    assert sorted(map(str, (r.doc_id for r in neardup.deduplicate(same).collect()))) == ["7", "8", "8", "8"]


# Nearest neighbours --------------------------------------------------------------------------------------


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def by_distance(rows, query, k):
    v = {i: np.array(e, np.float32).astype(float) for i, e, _ in rows}
    near = sorted((float(np.sqrt(((v[i] - v[query]) ** 2).sum())), i) for i in v if i != query)
    return near[:k]


def test_small_tables_are_searched_in_whole(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(size=12).astype(np.float32)], 0) for k in range(230)]
    rows += [(230 + k, rows[100][1], 0) for k in range(14)]  # more ties than are asked for
    got = nearest.search(vectors_of(spark, rows), F.col("vec_id") % 100 == 0).collect()
    for query in (0, 100, 200):
        mine = sorted((r.rank, r.score, r.vec_id) for r in got if r.query_id == query)
        want = by_distance(rows, query, 10)
        assert [r for r, *_ in mine] == list(range(1, 11)) and [(s, i) for _, s, i in mine] == [(pytest.approx(s, abs=0), i) for s, i in want]


def test_recall(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got = nearest.op2_nearest(spark, "/root/testdata/sf0.1").collect()
    queries = [i for i, *_ in rows if i % 100 == 0]
    hits = sum(len({r.vec_id for r in got if r.query_id == q} & {i for _, i in by_distance(rows, q, 10)}) for q in queries)
    assert hits >= 0.9 * 10 * len(queries)


def recall(spark, vectors, every):
    rows = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(vectors.astype(np.float32))], "vec_id long, embedding array<float>, label int")
    got = nearest.search(rows, F.col("vec_id") % every == 0).collect()
    exact = vectors.astype(np.float32).astype(float)
    hits = total = 0
    for q in range(0, len(exact), every):
        d = np.sqrt(((exact - exact[q]) ** 2).sum(1))
        d[q] = np.inf
        near = set(np.lexsort((np.arange(len(d)), d))[:10].tolist())
        hits += len(near & {r.vec_id for r in got if r.query_id == q})
        total += 10
    return hits / total


def test_recall_where_windows_are_a_small_share(spark, monkeypatch):
    """12,000 vectors with structure: windows of 0.2 % of the rows to either side suffice, so it is the curves that find them."""
    rng = np.random.default_rng(6)
    low = rng.normal(size=(12_000, 3)) @ rng.normal(size=(3, 24)) + 0.01 * rng.normal(size=(12_000, 24))
    monkeypatch.setattr(nearest, "SHARE", 0.002)
    monkeypatch.setattr(nearest, "LEAST", 24)
    assert recall(spark, low, 300) >= 0.9


def test_recall_without_structure_beyond_the_least_window(spark):
    """20,000 vectors without any: SHARE, not LEAST, rules."""
    rng = np.random.default_rng(9)
    assert nearest.SHARE * 20_000 > 2 * nearest.LEAST
    v = rng.normal(size=(20_000, 16))
    assert recall(spark, v / np.linalg.norm(v, axis=1, keepdims=True), 500) >= 0.9


@pytest.mark.parametrize("kind", ["cluster", "clusters", "far"])
def test_recall_in_crowded_cells(spark, kind):
    """A third of all rows within a millionth of each other, twenty such clusters, and one vector that is far off all others."""
    rng = np.random.default_rng(11)
    v = rng.normal(size=(12_000, 16))
    if kind == "cluster":
        v[::3] = v[0] + 1e-6 * rng.normal(size=(4_000, 16))
    elif kind == "clusters":
        v = v[rng.integers(0, 20, 12_000)] + 1e-6 * rng.normal(size=(12_000, 16))
    else:
        v[1] = 1e30
    assert recall(spark, v, 100) >= 0.9


def test_copies_are_exact(spark):
    """A third of all rows equal, and sizes beyond any window: the smallest vec_ids of the copies come first, at every query."""
    rng = np.random.default_rng(12)
    v = rng.normal(size=(9_000, 8)).astype(np.float32).astype(float)
    v[5::3] = v[5]
    v[3_000] = v[5]
    rows = [(k, x, 0) for k, x in enumerate(v.tolist())]
    got = nearest.search(vectors_of(spark, rows + rows[:3_000]), F.col("vec_id") % 500 == 0).collect()
    asked = [q for q in range(0, 9_000, 500) if (v[q] == v[5]).all()]
    assert 3_000 in asked and len(asked) > 5
    copies = np.flatnonzero((v == v[5]).all(1)).tolist()
    for q in asked:
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [c for c in copies if c != q][:10]


def test_one_vec_id_of_many_vectors(spark):
    """It counts once, at its least distance, and leaves the other places to others."""
    rows = [(0, [0.0, 1.0], 0)] + [(1, [0.001 * k, 1.0], 0) for k in range(1, 200)] + [(k, [float(k), 1.0], 0) for k in range(2, 30)]
    got = nearest.search(vectors_of(spark, rows), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, pytest.approx(0.001))] + [(k, float(k)) for k in range(2, 11)]


def test_odd_vectors(spark):
    one = [1.0, 2.0]
    rows = [(0, one, 1), (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [1.0, float("nan")], 1), (6, [float("inf"), 1.0], None), (7, [1.0, 4.0], 1)]
    rows += [(7, [1.0, 3.0], 1), (None, one, 1), (100, [1.0, 2.0, 3.0], 1), (101, [1.0, 2.0, 5.0], 1), (200, [0.5], 1)]
    got = nearest.search(vectors_of(spark, rows), F.col("vec_id") % 100 == 0).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 7, 1.0), (100, 1, 101, 2.0)]
    assert nearest.search(vectors_of(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    same = [(k, one, 1) for k in range(5)]
    assert [(r.vec_id, r.score) for r in nearest.search(vectors_of(spark, same), F.col("vec_id") == 0).orderBy("rank").collect()] == [(k, 0.0) for k in range(1, 5)]


# Pages ---------------------------------------------------------------------------------------------------


def page(body, k):
    items = "".join(f"<li><a href=/{k}{i}>entry {k}{i}</a>" for i in range(3))
    return (
        f"<!DOCTYPE html><html><head><title>t{k}</title><script>x = '<p>no</p>'</script></head><body class='page menu'><header><h1>Site</h1></header>"
        f"<nav><ul>{items}</ul></nav><p>Welcome to the site of sites.</p><div class='content'>{body}</div><div class='AdBox ad-slot'>Buy {k}</div>"
        f"<div id='comments'><p>Nice {k}</p></div><form>Send {k}</form><footer>&copy; {k}</footer></body></html>"
    )


def test_wrapper_finds_slots_among_template():
    pages = [page(f"<h1>Title {k}</h1><p>First&nbsp; &amp; {k}\n text<br>of it<p>Second <b>{k}</b> one<ul><li>a {k}<li>b {k}</ul>", k) for k in range(9)]
    assert wrapper.extract(pages) == [f"Title {k}\n\nFirst & {k} text of it\n\nSecond {k} one\n\na {k}\n\nb {k}" for k in range(9)]


def test_pages_of_different_lengths_align():
    pages = [page("".join(f"<p>par {j} of {k}</p>" for j in range(1 + k * 3)), k) for k in range(8)]
    assert wrapper.extract(pages) == ["\n\n".join(f"par {j} of {k}" for j in range(1 + k * 3)) for k in range(8)]


def test_lists_of_links_are_menus():
    body = "<ul><li><a href=1>one</a><li><a href=2>two</a></ul><ul><li>see <a href=1>one</a> there<li>text</ul><ol><li><a href=3>a single link</a></ol>"
    assert wrapper.extract([f"<div>{body}</div>"]) == ["see one there\n\ntext\n\na single link"]


def full_matching(a, b):
    """Simple tree matching as defined: every pair of children compared, no shortcut."""
    if a.label != b.label:
        return 0
    best = [[0] * (len(b.nodes) + 1) for _ in range(len(a.nodes) + 1)]
    for i, x in enumerate(a.nodes):
        for j, y in enumerate(b.nodes):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + full_matching(x, y))
    return 1 + best[-1][-1]


def random_page(rng, depth=0):
    out = ""
    for _ in range(rng.randint(0, 4)):
        tag = rng.choice(["div", "section", "b", "ul"])
        out += f"<{tag}>{random_page(rng, depth + 1) if depth < 3 else 'x'}</{tag}>"
    return out


def test_simple_tree_matching():
    a = wrapper.parse("<div><p>1</p><ul><li>x<li>y</ul><p>2</p></div>")
    b = wrapper.parse("<div><ul><li>x<li>y<li>z</ul><p>2</p><h2>n</h2></div>")
    shapes = wrapper.Shapes()
    for tree in (a, b):
        shapes.name(wrapper.in_order(tree))
    assert shapes.match(a.shape, a.shape) == len(wrapper.in_order(a)) == 7
    assert shapes.match(a.shape, b.shape) == 6  # root, div, ul, two li, p
    assert len(wrapper.align(a, b, shapes)) == 6


def test_alignment_equals_full_tree_matching():
    rng = random.Random(7)
    for _ in range(120):
        trees = [wrapper.parse(random_page(rng)) for _ in range(3)]
        shapes = wrapper.Shapes()
        for tree in trees:
            shapes.name(wrapper.in_order(tree))
        for a in trees:
            for b in trees:
                want = full_matching(a, b)
                assert shapes.match(a.shape, b.shape) == want
                matched = wrapper.align(a, b, shapes)
                assert len(matched) == want
                back = {id(x): y for y in wrapper.in_order(b) if (x := matched.get(id(y))) is not None}
                assert len(back) == want  # no node twice, and parents match where children do
                for x in wrapper.in_order(a):
                    if id(x) in back and x.parent is not None:
                        assert back[id(x)].label == x.label and back[id(x.parent)] is back[id(x)].parent


def test_long_lists_of_children_align_as_a_whole():
    rng = random.Random(3)
    names = [rng.choice("abcdef") for _ in range(700)]
    other = [n for n in names if rng.random() > 0.2]
    a, b = (wrapper.parse("".join(f"<{n}x>1</{n}x>" for n in part)) for part in (names, other))
    shapes = wrapper.Shapes()
    for tree in (a, b):
        shapes.name(wrapper.in_order(tree))
    assert shapes.match(a.shape, b.shape) == len(wrapper.align(a, b, shapes)) == 1 + len(other)


def plain_site(k, more=""):
    """A page without any name that tells its parts apart."""
    notice = ["Buy now.", "Meet us.", "Ask us.", "Call us."][k * 7 % 4]
    return (
        f"<html><body><div class=a>The site of sites</div><div class=b>{notice}</div><div class=c><h1>Title {k}</h1><p>First paragraph of page {k}, longer than all "
        f"the rest of it.</p>{f'<p>More of {k}.</p>' * (k % 3)}{more}</div><div class=d>Page {k} of our site</div></body></html>"
    )


def test_alignment_finds_the_main_text_without_any_name(monkeypatch):
    """The text comes from what pages show together: without the alignment it is lost among the rest, without the lists of names nothing changes."""
    pages = [plain_site(k) for k in range(24)]
    want = [f"Title {k}\n\nFirst paragraph of page {k}, longer than all the rest of it." + f"\n\nMore of {k}." * (k % 3) for k in range(24)]
    assert wrapper.extract(pages) == want
    for name in ("MARKS", "MARKED_TAGS", "MARKED_ROLES"):
        monkeypatch.setattr(wrapper, name, frozenset())
    assert wrapper.extract(pages) == want
    table = [h for (h,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.1/pages.parquet' WHERE url LIKE '%//tionble.example.org/%'").fetchall()]
    articles = wrapper.extract(table)
    monkeypatch.undo()
    assert len(table) == 133 and articles == wrapper.extract(table)
    assert all("&copy;" in h and "©" not in t for h, t in zip(table, articles, strict=True))
    # Nothing is known to stand at the same place: notices and footers stay.
    with monkeypatch.context() as m:
        m.setattr(wrapper, "CONSTANT_PAGES", 10**9)
        assert all("The site of sites" in t and "of our site" in t for t in wrapper.extract(pages))
    one = wrapper.extract(pages[:1])[0]
    assert "The site of sites" in one


def test_names_do_not_delete_parts_of_articles():
    more = '<h2 id="search">Search</h2><h2 id="copyright-law">Law</h2><h3 class="widget">W</h3><section id="social-policy"><p>Policy</p></section><p data-id="comments" title="see id=ad here">kept</p>'
    want = "\n\nSearch\n\nLaw\n\nW\n\nPolicy\n\nkept"
    assert wrapper.extract([f"<article><p>text</p>{more}</article>"]) == ["text" + want]
    pages = [plain_site(k, more + f"<div class=share>{k}</div>" if k == 3 else "") for k in range(24)]
    assert wrapper.extract(pages)[3].endswith(want + "\n\n3")  # a name that stands on one page only is no part of the site
    shared = [plain_site(k, f"<div class=share>Share {k}</div>") for k in range(24)]
    assert not any("Share" in t for t in wrapper.extract(shared))


def test_deep_menus_are_set_aside():
    deep = "<div>" * 130 + "<nav><p>menu</p></nav><p>text</p>" + "</div>" * 130
    assert wrapper.extract([deep]) == ["text"]
    assert wrapper.extract([deep.replace("text", f"text {k}") for k in range(9)]) == [f"text {k}" for k in range(9)]


def test_odd_pages():
    assert wrapper.extract([None, "", "   "]) == ["", "", ""]
    assert wrapper.extract(["just text &lt;b&gt; &#x41;"]) == ["just text <b> A"]
    assert wrapper.extract(["<p>a<p>b</div></p><!-- <p>no</p> --><table><tr><td>c<td>d</table><script>while(1)", "<article><p>open <b>bold", "<" * 50 + "x"])[:2] == ["a\n\nb\n\nc\n\nd", "open bold"]
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    assert wrapper.extract([deep]) == ["deep"]
    copies = ["<html><body><p>all the same here</p></body></html>"] * 8
    assert wrapper.extract(copies) == ["all the same here"] * 8
    long = "<p>" + "word " * 100_000 + "</p>"
    assert len(wrapper.extract([long])[0]) == 499_999


def test_slots_outside_the_largest_container_stay():
    body = [f"long text {k} " * 60 for k in range(9)]
    pages = [f"<html><body><h2>Site</h2><article><h1>Title {k}</h1><p class=lead>Lead {k}</p><div class=body><p>{body[k]}</p></div></article></body></html>" for k in range(9)]
    pages[8] = pages[8].replace("</body>", "<section><p>one more section</p></section></body>")
    want = [f"Title {k}\n\nLead {k}\n\n{body[k].strip()}" for k in range(9)]
    want[8] += "\n\none more section"
    assert wrapper.extract(pages) == want


def test_page_query(spark):
    rows = [(k, f"http://Host.example:80/{k}", page(f"<p>Text {k}</p>", k)) for k in range(40)] + [(99, None, "<p>x</p>"), (None, "nonsense", None), (7, "http://a/", page("<p>y</p>", 1))]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): r for r in wrapper.main_text(pages).collect()}
    assert len(got) == 43 and all(got[(k, f"http://Host.example:80/{k}")].text == f"Text {k}" for k in range(40))
    assert got[(99, None)].text == "x" and got[(None, "nonsense")].text == "" and all(r.n_chars == len(r.text) for r in got.values())
    assert wrapper.main_text(pages.limit(0)).count() == 0


def test_large_hosts_are_split(spark, monkeypatch):
    monkeypatch.setattr(wrapper, "PART", 20)
    pages = spark.createDataFrame([(k, "http://h/", page(f"<p>Text {k}</p>", k)) for k in range(300)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in wrapper.main_text(pages).collect()} == {k: f"Text {k}" for k in range(300)}
    monkeypatch.setattr(wrapper, "SENT", 0)
    assert {r.page_id: r.text for r in wrapper.main_text(pages).collect()} == {k: f"Text {k}" for k in range(300)}


def test_very_long_pages_make_smaller_groups(spark, monkeypatch):
    monkeypatch.setattr(wrapper, "GROUP_LETTERS", 15_000)
    pages = spark.createDataFrame([(k, "http://h/", page(f"<p>Text {k}</p>" * (1 + k % 9), k)) for k in range(60)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in wrapper.main_text(pages).collect()} == {k: "\n\n".join([f"Text {k}"] * (1 + k % 9)) for k in range(60)}


def test_no_group_of_a_host_is_a_small_rest(spark):
    for n in (129, 130, 257, 258):
        pages = spark.createDataFrame([(k, "http://h/", f"<body><h2>Site name</h2><p>Text {k}</p></body>") for k in range(n)], "page_id long, url string, html string")
        want = {k: f"Text {k}" for k in range(n)}
        assert {r.page_id: r.text for r in wrapper.main_text(pages).collect()} == want


def test_entities_and_nul(spark):
    assert pa.array(wrapper.extract(["<p>&#0;&#xD800;&bogus; &amp;amp;</p>"])).type == pa.string()


# The pipeline --------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.staged(stage(spark, docs, SF))
        seen[name] = docs, out
        docs = out
        assert out.columns == columns or name == corpus_pipeline.STAGES[-1][0]
    before, after = seen["quality"]
    model = quality.learn(before, common.read(spark, SF, "labels"))
    good = {r.doc_id for r in quality.score(before, model, ["doc_id"]).filter("score >= 0.5").collect()}
    assert {r.doc_id for r in after.collect()} == good
    before, after = seen["near_copies"]
    texts = [(r.doc_id, r.text) for r in before.collect()]
    want, _ = components(texts, 5, 80)
    assert {r.doc_id for r in after.collect()} == {i for i, root in want.items() if i == root}
    before, after = seen["secrets"]
    clean = {r.doc_id: r.text for r in after.collect()}
    for r in before.collect():
        spans = secrets.all_spans(r.text, secrets.base_spans(r.text))
        merged = []
        for start, _, end in spans:
            if merged and start < merged[-1][1]:
                merged[-1][1] = max(end, merged[-1][1])
            else:
                merged.append([start, end])
        want = r.text
        for start, end in reversed(merged):
            want = want[:start] + "[secret]" + want[end:]
        assert clean[r.doc_id] == want
    before, after = seen["mixing"]
    times = Counter(r.doc_id for r in after.collect())
    assert max(times.values()) <= 2 and set(times) <= {r.doc_id for r in before.collect()}
    size = {r.doc_id: len(words(r.text)) for r in before.collect()}
    assert sum(size[i] * n for i, n in times.items()) == pytest.approx(1.5 * sum(size.values()), rel=0.1)
    for source in {r.source for r in before.collect()}:
        mine = {r.doc_id for r in before.collect() if r.source == source}
        target = next(r.target for r in mixing.mix(before).collect() if r.source == source)
        assert abs(sum(size[i] * times[i] for i in mine) - target) <= 2 * max(size[i] for i in mine) + 2 * mixing.BLOCK_WORDS
    before, packed = seen["packing"]
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: np.array([*exact.encode(r.text, add_special_tokens=False).ids, 1], "<u4") for r in before.collect()}
    laid = packed.collect()
    assert sum(r.length for r in laid) == sum(len(ids[r.doc_id]) for r in before.collect())
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32 for r in laid)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_pipeline_stages_of_odd_and_empty_tables(spark):
    for docs in (odd(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.staged(stage(spark, docs, SF))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
                docs = out


def test_run_and_registry(spark):
    from tickerloom.llm import registry

    assert len(registry.queries()) == 11 and set(registry.oracle_sql()) <= set(registry.queries())
    before = common.begun()
    packed = corpus_pipeline.run(spark, SF)
    # Of four stages only the last one's result is left, and what packing reads.
    assert packed.count() > 0 and common.begun() - before <= 4
    common.sweep(spark)
