"""Main text, spelling variants and the Merkle manifest against brute force and hard cases."""

import hashlib
import html
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import anagrams, main_text, merkle, queries
from riskweave.llm.workspace import Workspace

SF = "/root/testdata/sf0.001"

# 11 --------------------------------------------------------------------------
PAGES = {
    "text without markup &amp; more": "text without markup & more",
    "<article><p>a<p>b<script>x < y </p></script><p>c<!-- <p>d --><p title='a>b'>e</p></div></b><p>f <a href=x>link</p>": "a\nb\nc\ne\nf link",
    "<nav><ul><li><a href=/a>Menu</a></ul></nav><article><h1>Head &lt;1&gt;</h1><p><b>One,\n two<br>three&nbsp;four<p>Five</article><footer>&copy; all</footer>": "Head <1>\nOne, two three four\nFive",
    # frames, notices, adverts, forms and reader comments around and inside the article
    "<body class='comments-open'><header><h1>Site</h1></header><div id=cookie-notice>We use cookies, ok, fine, yes, and more</div><main><article><header><h1>Title</h1></header>"
    "<p>Hello, <b>big</b> world, this is text.</p><aside>side</aside><form><input>Sign up</form><p>Second <span class=ad>BUY</span> line.<ul><li><a href=x>rel</a><li><a href=y>other</a></ul></article>"
    "<section id=comments><article><p>Nice, very, very, nice, yes, great long comment, so, many, commas</p></article></section></main><footer>f</footer>": "Title\nHello, big world, this is text.\nSecond line.",
    # no element says what it is: the best container, with its heading
    "<div id=wrap><div class=top-header>Logo</div><div class=sidebar><p>Long side text, with, many, commas, and more text so that it is long enough.</div><div id=x><h1>T</h1><div><p>One, two, three and four.<p>Five six, seven.</div></div></div>": "T\nOne, two, three and four.\nFive six, seven.",
    "<div><div><p>First part, with commas, and words enough to score.</div><div><p>Second part, with commas, and words enough as well.</div><div><a href=a>one link</a> <a href=b>two links</a></div></div>": "First part, with commas, and words enough to score.\nSecond part, with commas, and words enough as well.",
    "<form id=page><div><article><p>Inside of a form, all of it.</p></article></div><input></form>": "Inside of a form, all of it.",
    "<div class='post no-comments'><p>Real text, here it is.</p></div><div class=ad>z</div>": "Real text, here it is.",
    "<body><div hidden><p>Not, shown, to, anyone, at all</div><div style='display: none'>no</div><p>Shown</body>": "Shown",
    "<table><tr><td>a, cell<td>b, cell<tr><td>c</table>": "a, cell\nb, cell\nc",
    "<a <a <a": "",
    "<script>never ends <p>x": "",
    "": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text_of_pages(page):
    assert main_text.main_text(page) == PAGES[page]


def test_main_text_takes_linear_time():
    for page in ("<div>" * 50_000 + "x", "<p>a" * 50_000, "<a " * 100_000, '<p x="' * 50_000, "</div>" * 100_000, "<!-- " * 100_000, "<ul><li>" * 50_000, "<p title='\"" * 50_000):
        began = time.perf_counter()
        main_text.main_text(page)
        assert time.perf_counter() - began < 5


def test_main_text_columns(spark):
    long = "<article>" + "<p>word, word</p>" * 60_000 + "</article>"
    rows = [(1, None), (2, ""), (3, "<p>é&eacute;</p>"), (3, "<p>é&eacute;</p>"), (None, long)]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("clash")).withColumn("parent", F.lit(7))
    got = main_text.extract(pages)
    assert got.columns == ["page_id", "html", "parent", "text", "n_chars"]
    found = Counter((r.page_id, r.text, r.n_chars) for r in got.collect())
    text = "\n".join(["word, word"] * 60_000)
    assert found == Counter([(1, "", 0), (2, "", 0), (3, "éé", 2), (3, "éé", 2), (None, text, len(text))])
    assert main_text.extract(pages.limit(0)).count() == 0


def test_op11_equals_a_plain_reading_of_the_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op11_main_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.search("<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in re.split("</?(?:p|h1)>|<br>", body))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


# 12 --------------------------------------------------------------------------
def plain_words(rows, slips=None, least=1):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if slips and h % slips == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                counts[run] += 1
    return counts


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(counts, min_count, ratio):
    words = {w: n for w, n in counts.items() if n >= min_count}
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= ratio * words[w]:
            form[w] = best
    out = set()
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.add((w, words[w], len(near[w]), form.get(w), words.get(form.get(w)), root))
    return out


@pytest.mark.parametrize("min_length", [1, 4])
def test_variants_equal_brute_force(spark, min_length):
    rng = random.Random(min_length)
    words = ["".join(rng.choices("abÀé", k=rng.randint(1, 6))) for _ in range(150)] + ["aabb", "abab", "baba", "aab", "abbb", "aaaa", "aaa"]
    rows = [(i, " ".join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(words, k=60, weights=[1 / (j + 1) ** 2 for j in range(len(words))]))) for i in range(80)]
    rows += [(None, None), (None, ""), (5, "x1y2-,"), (5, "aabb " * 400), (5, "aabb " * 400), (None, "Aabb×÷ aabb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "word", "n", "key", "near")})
    got = {tuple(r) for r in anagrams.variants(docs, Workspace(spark, "t"), min_length=min_length, min_count=2, ratio=3, slips=7).collect()}
    want = plain_variants(plain_words(rows, 7, min_length), 2, 3)
    assert got == want and len({w[0] for w in want if w[5] != w[0]}) > 5


def test_chains_of_forms_are_followed(spark):
    text = "letterss " * 2 + "letters " * 20 + "lettera " * 300 + "lettara " * 5000 + "latterr lattera " * 2
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {r.word: r for r in anagrams.variants(docs, Workspace(spark, "t")).collect()}
    assert [got[w].form for w in ("letterss", "letters", "lettera", "lettara")] == ["letters", "lettera", "lettara", None]
    assert {got[w].root for w in ("letterss", "letters", "lettera", "lettara")} == {"lettara"}
    assert got["latterr"].form is None and got["latterr"].n_near == 1 and got["lattera"].n_near == 2


def test_hot_anagrams_and_very_long_words(spark):
    """Anagrams do not meet, and a word of a million letters takes memory in proportion."""
    rng = random.Random(1)
    anagram = {"".join(rng.sample("abcdefghij", 10)) for _ in range(3000)}
    long = "abcdefgh" * 40_000
    docs = spark.createDataFrame([(1, " ".join(anagram)), (2, " ".join(anagram)), (3, long), (4, long + " " + long[1:]), (5, long[1:])], "doc_id long, text string")
    ws = Workspace(spark, "t")
    words = ws.table("w", anagrams.count_words(docs).select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    pairs = anagrams.near_words(words, ws).count()
    got = anagrams.variants(docs, Workspace(spark, "t"))
    assert pairs == 2 and got.count() == len(anagram) + 2 and got.filter("n_near = 1").count() == 2


def test_keys_do_not_depend_on_the_batch():
    words = ["letters", "aab", "ÿÿÿ", "b"]
    whole = np.column_stack([np.asarray(c, np.int64) for c in anagrams.keys_of(np.arange(4), words)])
    apart = np.concatenate([np.column_stack([np.asarray(c, np.int64) for c in anagrams.keys_of(np.array([i]), [w])]) for i, w in enumerate(words)])
    assert Counter(map(tuple, whole.tolist())) == Counter(map(tuple, apart.tolist()))


def test_no_words_no_variants(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert anagrams.variants(docs, Workspace(spark, "t")).count() == 0
    assert anagrams.variants(docs.limit(0), Workspace(spark, "t")).count() == 0
    with pytest.raises(ValueError):
        anagrams.variants(docs, Workspace(spark, "t"), ratio=1)


# 13 --------------------------------------------------------------------------
def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    """Root, and per leaf the list of (place, others)."""
    paths, level = [[] for _ in leaves], list(leaves)
    while len(level) > 1:
        for i, path in enumerate(paths):
            at = i // 8 ** len(path)
            run = level[at // 8 * 8: at // 8 * 8 + 8]
            path.append((at % 8, "".join(run[: at % 8] + run[at % 8 + 1:])))
        level = [sha("".join(level[i: i + 8])) for i in range(0, len(level), 8)]
    return level[0], paths


def plain_manifest(rows):
    """rows of (tree, order, leaf, tampered)."""
    none_first = lambda x: (x is not None, x or 0) if not isinstance(x, str) else (True, x.encode())
    trees = sorted({r[0] for r in rows}, key=none_first)
    built = {}
    for t in trees:
        own = sorted((r for r in rows if r[0] == t), key=lambda r: (none_first(r[1]), r[2]))
        built[t] = own, *plain_tree([r[2] for r in own])
    root, ups = plain_tree([built[t][1] for t in trees])
    out = []
    for t, up in zip(trees, ups, strict=True):
        own, subroot, paths = built[t]
        for r, path in zip(own, paths, strict=True):
            node = r[2] if r[3] is None else r[3]
            for place, others in path + up:
                node = sha(others[: 64 * place] + node + others[64 * place:])
            out.append((r[1], r[2], subroot, root, sha("".join(o for _, o in path + up)), node, node == root))
    return Counter(out)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 511, 512])
def test_traversal_equals_the_plain_tree(n):
    leaves = [sha(str(i)) for i in range(n)]
    root, paths = plain_tree(leaves)
    levels = merkle.height(n)
    assert merkle.block_root(leaves, levels) == root
    assert list(merkle.traverse(leaves, levels)) == paths
    assert all(merkle.fold(x, p) == root for x, p in zip(leaves, paths, strict=True))


def test_traversal_keeps_a_bounded_memory(monkeypatch):
    kept = []
    add = merkle.Run.add

    def counted(self, leaf):
        add(self, leaf)
        kept.append(sum(map(len, self.pending)))

    monkeypatch.setattr(merkle.Run, "add", counted)
    leaves = [sha(str(i)) for i in range(4096)]
    assert list(merkle.traverse(leaves, 4)) == plain_tree(leaves)[1]
    assert max(kept) <= 8 * 4


def test_manifest_equals_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for tree, n in (("en", 1500), (None, 530), ("é", 512), ("", 1), ("de", 9), ("z", 8)):
        rows += [(tree, rng.randint(0, n) if i else None, sha(f"{tree}{i}"), sha(f"x{i}") if i % 3 == 0 else None) for i in range(n)]
    rows += [("en", 7, sha("same"), None)] * 600  # equal rows
    rows += [(f"t{i}", 1, sha(str(i)), None) for i in range(600)]  # more trees than a block holds
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "tree string, ord long, leaf string, tampered string").withColumns({c: F.lit("clash") for c in ("id", "total", "at", "block", "digest")})
    got = merkle.manifest(df, Workspace(spark, "t"), tree_col="tree", order_col="ord", leaf_col="leaf", tampered_col="tampered")
    assert got.columns == ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == plain_manifest(rows)


def test_leaves_of_hard_rows(spark):
    rows = [(1, None, None, None), (2, "", "é", 5), (None, "x", "a:b-", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    got = [r[0] for r in docs.select(merkle.leaf(F.col("doc_id"), F.col("lang"), F.col("n_chars"), F.col("text"))).collect()]

    def part(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    assert got == [sha(part(a) + part(c) + part(d) + part(b)) for a, b, c, d in rows]


def test_manifest_of_one_and_of_no_rows(spark):
    df = spark.createDataFrame([("en", 1, sha("a"), None)], "tree string, ord long, leaf string, tampered string")
    args = {"tree_col": "tree", "order_col": "ord", "leaf_col": "leaf", "tampered_col": "tampered"}
    one = merkle.manifest(df, Workspace(spark, "t"), **args).collect()[0]
    assert tuple(one) == (1, sha("a"), sha("a"), sha("a"), sha(""), sha("a"), True)
    assert merkle.manifest(df.limit(0), Workspace(spark, "t"), **args).count() == 0


# near-duplicates and pipeline stages ------------------------------------------
def test_copies_of_one_id_are_one_text(spark, monkeypatch):
    """A third of all rows the same: blocks stay within twice their bound."""
    from riskweave.llm import forest

    sizes = []
    confirm = forest.confirm_blocks

    def watched(rows, *args):
        sizes.extend(r["count"] for r in rows.groupBy(*forest.BLOCK_KEYS).count().collect())
        return confirm(rows, *args)

    monkeypatch.setattr(forest, "confirm_blocks", watched)
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base))] * 900
    rng = random.Random(4)
    for i in range(2, 60):  # near, not linked: a quarter of the words differ
        own = list(base)
        for k in rng.sample(range(60), 3):
            own[k] = f"x{i}y{k}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = forest.near_duplicates(df, Workspace(spark, "t"), block_rows=16).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got if r["id"] == 1) == 900
    assert max(sizes, default=0) <= 32


def test_keys_of_split_regions_do_not_count_as_met(spark):
    from riskweave.llm import forest

    rows = [(1, b"a", [10, 20, 30]), (2, b"b", [10, 21, 30])]
    classes = spark.createDataFrame(rows, "id long, own binary, keys array<long>")
    got = {r["id"]: r["keys"] for r in forest.hide_keys(classes, spark.createDataFrame([(10,)], "key long")).collect()}
    assert got[1][0] != got[2][0] and [k[1:] for k in (got[1], got[2])] == [[20, 30], [21, 30]]


@pytest.mark.parametrize("number", range(5))
def test_stages_of_the_pipeline_on_hard_rows(spark, number):
    import corpus_pipeline

    rows = [(1, None, None, None, None), (2, "", "en", "s1", 0), (5, "  \n\t ", "en", None, 4), (4, "a b c d e f g h", "en", "s2", 1), (4, "a b c d e f g h", "en", "s2", 1), (6, "word " * 30_000, "de", "s2", 1), (None, "no id here at all", "en", "s3", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    name, stage = corpus_pipeline.STAGES[number]
    clash = docs.withColumns({c: F.lit("clash") for c in ("_rw_id", "_rw_id_", "_rw_row", "_rw_text", "_RW_toxicity", "_kept", "_score", "_size", "_target", "score", "kept", "id", "size", "ids", "n", "row")})
    out = stage(spark, clash, SF)
    got = out.collect()
    assert stage(spark, clash.limit(0), SF).count() == 0
    if number < 4:
        assert out.columns == clash.columns
        assert all(r[c] == "clash" for r in got for c in clash.columns[5:])
    counts = Counter(r["doc_id"] for r in got)
    assert set(counts) <= {None, 1, 2, 4, 5, 6}
    if number == 2:
        assert counts == Counter([1, 2, 4, 5, 6, None])
    if number == 3:
        assert set(counts) <= {4, 6, None} and max(counts.values()) <= 6
    if number == 4:
        assert counts == Counter([1, 2, 4, 4, 5, 6, None])
