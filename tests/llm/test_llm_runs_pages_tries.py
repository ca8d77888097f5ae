"""Periodic runs, main texts of pages, and the trie of conversations, against plain versions."""

import hashlib
import os
import random
import re
import sys
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from compare import differences, duck
from fixtures import odd_documents

from answerloom.llm import conversation_trie as trie
from answerloom.llm import html_extraction as pages
from answerloom.llm import periodic_runs as periodic
from answerloom.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_runs(words, min_length=6, min_exponent=4):
    out, n = [], len(words)
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(min_length, min_exponent * q):
                own = words[i : i + length]
                if not any(own[d:] == own[: length - d] for d in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repeating_texts(seed=2, n=300):
    r = random.Random(seed)
    for _ in range(n):
        words, size, voc = [], r.choice([0, 1, 5, 6, 7, 8, 12, 30, 90, 200]), r.choice([1, 2, 3, 60])
        while len(words) < size:
            block = [f"w{r.randrange(voc)}" for _ in range(r.randrange(1, 9))]
            words += block * r.choice([1, 1, 2, 4, 7])
        yield r.choice(["", " ", "\n"]) + r.choice([" ", "  ", "\t"]).join(words[:size]) + r.choice(["", " "])


def test_runs_by_brute_force(spark):
    texts = list(repeating_texts())
    df = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string").repartition(5)
    found = 0
    for length, exponent in ((6, 4), (2, 2), (9, 3)):
        for row in periodic.periodic_runs(df, length, exponent).collect():
            words = WORD.findall((texts[row.id] if row.id < len(texts) else "") or "")
            want = plain_runs(words, length, exponent)
            assert [tuple(x) for x in row.runs] == want and row.n_words == len(words)
            assert row.collapsed == plain_collapsed(words, want)
            if want:
                top = max(want, key=lambda x: (x[1] / x[2], -x[0], -x[2]))
                assert tuple(row.top) == top
            found += len(want)
    assert found > 300
    with pytest.raises(ValueError):
        periodic.periodic_runs(df, min_exponent=1)


def test_ranks_of_all_suffixes():
    r = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        symbols = np.append(r.integers(0, 3, n), 99)
        levels, _ = periodic.suffix_ranks(symbols)
        by = sorted(range(n + 1), key=lambda i: symbols[i:].tolist())
        assert np.argsort(levels[-1]).tolist() == by


def test_run_query_follows_its_contract(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = {r.doc_id: r for r in queries.op12_periodic_runs(spark, sf_dir).collect()}
    assert rows.keys() == texts.keys()
    repeating = 0
    for i, text in texts.items():
        words = WORD.findall(text or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
        if n > 1500:
            continue  # the plain version is quadratic
        want = plain_runs(words)
        row = rows[i]
        top = max(want, key=lambda x: (x[1] / x[2], -x[0], -x[2])) if want else (None, None, None)
        assert (row.n_runs, row.start, row.length, row.period) == (len(want), *top)
        assert row.exponent_milli == (1000 * top[1] // top[2] if want else None)
        assert row.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in want))
        assert row.collapsed_sha256 == sha(plain_collapsed(words, want))
        repeating += bool(want)
    assert repeating > 5


def test_runs_of_odd_rows(spark):
    docs = odd_documents(spark)
    rows = queries_digest(periodic, docs)
    assert sum(map(len, rows.values())) == docs.count() and rows[2][0].n_runs == 0 and rows[2][0].collapsed_sha256 == sha("")
    assert len(rows[5]) == 2 and rows[5][0] == rows[5][1]
    assert rows[4][0].n_runs == 1 and rows[4][0].period == 21  # a text of 8,000 equal blocks
    assert periodic.run_digest(periodic.periodic_runs(periodic.with_repeated_tails(docs.limit(0)))).count() == 0


def queries_digest(module, docs):
    out = defaultdict(list)
    for r in module.run_digest(module.periodic_runs(docs)).collect():
        out[r.doc_id].append(r)
    return out


PAGE = """<!doctype html><html><head><title>T &amp; t</title><style>p {}</style></head><body class="has-sidebar">
<div id="siteHeader">My site</div><ul class="main-menu"><li>Home<li>About</ul><script>var a = "</p>";</script>
<article><header><h1>A  head&shy;line</h1></header><p>One&nbsp;two <i>th</i>ree<br>four &lt;b&gt;<p>Second
 para<!-- <p>no --><div class='ad'>Buy!</div><table><tr><td>x<td>y</table><form>Mail <button>Go</button></form>
<aside>aside</aside><section id="comments"><article>I agree</article></section><p hidden>q</p>1 < 2</article>
<div class="cookie-notice">We use cookies</div><footer>(c)</footer></body></html"""


def test_declared_article():
    text = pages.kept_text(pages.page_blocks(PAGE), None)
    assert text.split("\n") == ["A head\xadline", "One two three four <b>", "Second para", "x", "y", "1 < 2"]
    main = pages.page_blocks("<nav>n</nav><main><h1>h</h1><div class=breadcrumb>b</div>text<p>more</main>rest")
    assert pages.kept_text(main, None) == "h\ntext\nmore"


@pytest.mark.parametrize("html", ["", "   ", "<", "<p", "<a href='x", "<!--", "<!-- x", "</div></div>", "<script>x", "&#x110000;&#0;&bogus;", "<p>a</p", "<svg><p>x</svg>y"])
def test_broken_markup(html):
    blocks = pages.page_blocks(html)
    assert all(text == " ".join(text.split()) for _, text in blocks)


def host_pages(n=30):
    """Pages of two hosts without an article, with the host's own chrome in plain blocks, and unique paragraphs."""
    r = random.Random(4)
    out = []
    for i in range(n):
        host = "a.example" if i % 3 else "b.example"
        own = [" ".join(f"w{r.randrange(5000)}" for _ in range(r.randrange(9, 40))) for _ in range(3)]
        top = f"<div>Start<div>News of {host} every day for all of you at home</div></div><div>Contact us</div>"
        end = f"<div>Copyright {host} all rights reserved and so on and on, page {i}</div>"
        out.append((i, f"https://{host}/p/{i}", f"<body>{top}<p>{own[0]}</p><p>{own[1]}<div>{own[2]}</div>{end}</body>", "\n".join(own)))
    return out


def test_repeats_of_a_host_go(spark):
    rows = host_pages()
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").repartition(4)
    got = {r.id: r for r in pages.main_texts(df).collect()}
    assert {i: r.text for i, r in got.items()} == {i: text for i, _, _, text in rows}
    assert all(r.n_chars == len(r.text) for r in got.values())
    one = pages.main_texts(df.where("page_id = 0")).first()  # nothing to compare it with
    assert one.text.startswith("Start\nNews") and one.text.endswith("page 0")
    copies = spark.createDataFrame([(i, "http://c.example/", "<p>the very same page in every word of it all</p>") for i in range(3)], "page_id long, url string, html string")
    assert {r.text for r in pages.main_texts(copies).collect()} == {"the very same page in every word of it all"}


def test_repeats_are_those_of_plain_windows(spark):
    """Substrings that two pages share, by the distributed names and by plain Python."""
    rows = [r[:3] for r in host_pages(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    counts = pages.host_substrings(pages._hosted(df, "page_id", "url", "html"))
    got = {h: set(r.n for r in counts.where(F.col("host") == h).where("name is not null").collect()) for h in ("a.example", "b.example")}
    n = {h: counts.where(F.col("host") == h).where("name is not null").count() for h in got}
    want = defaultdict(lambda: defaultdict(set))
    for i, url, html in rows:
        stream = ["¶"]
        for _, text in pages.page_blocks(html):
            stream += [*text.split(), "¶"]
        marks = [k for k, t in enumerate(stream) if t == "¶"]
        own = {tuple(stream[k : k + pages.WINDOW]) for k in range(len(stream) - pages.WINDOW + 1)}
        own |= {("block", *stream[a : b + 1]) for a, b in zip(marks, marks[1:]) if b - a < pages.WINDOW - 1}
        for w in own:
            want[url.split("/")[2]][w].add(i)
    for host, found in want.items():
        shared = {w: len(p) for w, p in found.items() if len(p) >= pages.MIN_PAGES}
        assert n[host] == len(shared) and got[host] == set(shared.values())


SOLD, FEWER = "This text is sold to papers by our own agency", "Both of these towns lie on the river we told of"


def articles():
    """40 articles of a host in four parts, where 21 have SOLD and 19 have FEWER, mostly in the first parts; 9 of another
    host that all have SOLD; 12 versions of one article."""
    r = random.Random(5)
    sold = [*range(18), 20, 21, 30]
    fewer = [*range(2, 20), 22]
    out = []
    for i in range(61):
        own = " ".join(f"w{r.randrange(10**6)}" for _ in range(60))
        if i < 40:
            host, said, left = "d.example", [SOLD] * (i in sold) + [FEWER] * (i in fewer), [FEWER] * (i in fewer)
        elif i < 49:
            host, said, left = "e.example", [SOLD], [SOLD]
        else:
            host, own, said, left = "f.example", f"Version {i}", ["a body of many words that all of them have " * 8], ["a body of many words that all of them have " * 8]
        html = f"<nav>Home</nav><article><h1>Ingredients</h1><p>{own}</p>{''.join(f'<p>{t}</p>' for t in said)}</article>"
        out.append((i, f"https://{host}/{i}", html, "\n".join(t.strip() for t in ["Ingredients", own, *left])))
    return [out[10 * j : 10 * j + 10] + out[40 + j :: 4] for j in range(4)]


def in_parts(spark, parts):
    rows = spark.sparkContext.parallelize([[r[:3] for r in part] for part in parts], len(parts)).flatMap(lambda part: part)
    return rows.toDF("page_id long, url string, html string")


def test_what_most_articles_of_a_host_share_goes(spark):
    parts = articles()
    df = in_parts(spark, parts)
    want = {i: text for part in parts for i, _, _, text in part}
    assert {r.id: r.text for r in pages.main_texts(df).collect()} == want
    assert {r.id: r.text for r in pages.main_texts(df.repartition(7)).collect()} == want


@pytest.mark.parametrize("n", [None, 1, 30])
def test_shared_substrings_of_articles_are_those_of_plain_windows(spark, n):
    """Whatever the parts tell; in the four parts as given, some counts are left open by their bounds."""
    parts = articles()
    df = in_parts(spark, parts)
    hosted = pages._hosted(df if n is None else df.repartition(n), "page_id", "url", "html")
    counts = pages.host_substrings(hosted)
    got = {r.host: set(r.shared) for r in pages.article_repeats(hosted, counts).collect()}
    names, found, articles_of = pages.Names(), defaultdict(lambda: defaultdict(set)), defaultdict(int)
    for i, url, html, _ in (r for part in parts for r in part):
        stream = ["¶"]
        for kind, text in pages.page_blocks(html):
            if kind == pages.DECLARED:
                stream += [*text.split(), "¶"]
        articles_of[host := url.split("/")[2]] += 1
        for k in range(len(stream) - pages.WINDOW + 1):
            found[host][tuple(stream[k : k + pages.WINDOW])].add(i)
    name = lambda w: int(pages.window_suffixes(np.array([0 if t == "¶" else names.of(t) for t in w], dtype=np.uint64)).view(np.int64)[0])
    least = {h: max(pages.MIN_ARTICLES, pages.ARTICLE_SHARE * m) for h, m in articles_of.items()}
    want = {h: {name(w) for w, p in each.items() if len(p) >= least[h]} for h, each in found.items()}
    assert got == {h: each for h, each in want.items() if each} and set(got) == {"d.example", "f.example"}
    if n is None:
        told = {r.name: r.n for r in counts.where("declared and host = 'd.example'").collect()}
        assert told[name(SOLD.split()[:8])] == told[name(FEWER.split()[:8])] == 18


def test_odd_pages(spark):
    rows = [(1, None, "<article>x</article>", 1), (1, None, "<article>x</article>", 1), (None, "u", None, 2), (2, "", "", 3), (3, "http://h/", "<p>" + "long words " * 100_000, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host long")
    got = pages.main_texts(df).collect()
    assert sorted((r.id or 0, r.n_chars) for r in got) == [(0, 0), (1, 1), (1, 1), (2, 0), (3, 1_099_999)]
    assert pages.main_texts(df.limit(0)).count() == 0


def plain_trie(conversations):
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for conv, turns in conversations:
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
        ends[tuple(turns)].append(conv)
    for node in members:
        if node:
            kids[node[:-1]].add(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = ((len(members[node]) - 1) * len(node[-1][1]) if node else 0) + sum(saved[k] for k in kids[node])
    return {
        (min(own), len(node)): (
            *(min(members[node[:-1]]) if node else None, len(own), len(kids[node]), leaves[node], saved[node]),
            sha(",".join(map(str, sorted(ends[node])))),
        )
        for node, own in members.items()
    }


def plain_sequences(rows, heads=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in own.items()}
    if not heads:
        return list(own.items())
    return [(c, own.get(c - c % 100, [])[: (h := zlib.crc32(str(c).encode()) % 6)] + v[h:]) for c, v in own.items()]


def talks(seed=0):
    r = random.Random(seed)
    rows = []
    for conv in range(300):
        for turn in range(r.choice([0, 1, 1, 2, 3, 5, 8])):
            rows.append((conv, turn or r.choice([0, None]), r.choice(["user", None]), r.choice(["a", "bb", None, "d\U0001f600"])))
    return rows + [(10_000 + i, 0, "user", "hot") for i in range(2000)] + [(None, 0, "user", "lost")]


@pytest.mark.parametrize("limits", [(), (40, 7), (3, 3)])
def test_trie_by_brute_force(spark, limits):
    rows = talks()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    sequences = trie.with_shared_heads(trie.turn_sequences(df))
    nodes = trie.conversation_trie(sequences, *limits).collect()
    got = {(r.conv_id, r.depth): tuple(r)[2:] for r in nodes}
    assert len(nodes) == len(got) and got == plain_trie(plain_sequences(rows))


def test_close_of_every_parenthesis():
    r = random.Random(3)
    for n in (1, 2, 63, 64, 65, 700, 5000):
        steps, open_ = [], 0
        while len(steps) < 2 * n - open_:
            up = not open_ or (r.random() < 0.55 and len(steps) + open_ < 2 * n - 1)
            steps.append(1 if up else -1)
            open_ += steps[-1]
        steps += [-1] * open_
        stack, want = [], {}
        for i, s in enumerate(steps):
            if s > 0:
                stack.append(i)
            else:
                want[stack.pop()] = i
        # a tree has one root: the sequence is wrapped
        steps = np.array([1, *steps, -1])
        want = {a + 1: b + 1 for a, b in want.items()} | {0: len(steps) - 1}
        at = np.flatnonzero(steps > 0)
        assert trie.Parentheses(steps).find_close(at).tolist() == [want[i] for i in at.tolist()]


def test_odd_conversations(spark):
    rows = [(1, None, None, None), (1, None, None, None), (None, 1, "user", "x"), (2, 5, "user", ""), (3, 1, "user", "long " * 200_000), (4, 1, "user", "long " * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"key": F.lit(1), "turns": F.lit("x"), "kind": F.lit(2)})
    got = {(r.conv_id, r.depth): tuple(r)[2:] for r in trie.conversation_trie(trie.turn_sequences(df)).collect()}
    assert got == plain_trie(plain_sequences(rows, heads=False))
    assert trie.conversation_trie(trie.with_shared_heads(trie.turn_sequences(df.limit(0)))).count() == 0
    shown = trie.with_last_turns(trie.conversation_trie(trie.turn_sequences(df)), df.select("conv_id", "turn", "text"))
    assert {(r.conv_id, r.depth): len(r.text or "") for r in shown.collect()}[3, 1] == 1_000_000


@pytest.mark.parametrize("name", ["op11_html_extraction", "op13_conversation_trie"])
def test_sql_twins(spark, sf_dir, name):
    assert differences(queries.QUERIES[name](spark, sf_dir), duck(sf_dir), queries.ORACLES[name]) == []


def test_extraction_of_whole_pages_by_another_rule(spark, sf_dir):
    from html import unescape

    want = {}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        body = re.search(r"(?s)<article>(.*)</article>", r.html)[1]
        parts = [" ".join(unescape(re.sub("</?b>", "", p.replace("<br>", " "))).split()) for p in re.split("</?(?:p|h1)>", body)]
        want[r.page_id] = "\n".join(p for p in parts if p)
    assert {r.page_id: r.text for r in queries.op11_html_extraction(spark, sf_dir).collect()} == want


def test_dictionary_words_are_told_by_their_bytes():
    column = pa.array(["x" * 3000 + " " + "x" * 3001, None, "a\x00b a\x00c"])
    *_, numbers, first = periodic.word_numbers(column)
    assert first.tolist() == [0, 2, 2, 4] and len(set(numbers.tolist())) == 4
