"""WARC bundles, page text, chat formatting, the pipeline."""

import base64
import hashlib
import io
import itertools
import json
import random
import uuid

import pytest
import zstandard

import corpus_pipeline
from deltaloom.llm import chat_tools, html_mincut, ngram_join, warc_bundles
from deltaloom.llm.common import fresh_path
from deltaloom.llm.queries import QUERIES

PAGES = "page_id long, url string, html string, sha int, record_type string"


def test_bundles_round_trip(spark):
    pages = [(3, "http://a/", "same"), (1, "http://b/ x", "same"), (7, None, "same"), (2, "u", ""), (4, "u", None), (5, "u", "é" * 50_000), (None, "u", "same"), (6, "u", "other"), (6, "u", "other"), (8, "u", "other"), (1, "http://b/ x", "same")]
    df = spark.createDataFrame([(*p, 1, "x") for p in pages], PAGES).repartition(3)
    manifest = warc_bundles.write_bundles(df, fresh_path(spark, "w"), frame_bytes=60_000)
    names = [n for r in manifest.collect() for n, _, _ in warc_bundles.BundleReader(open(r.path.removeprefix("file:"), "rb")).index]
    assert len(set(names)) == len(pages)
    responses = {str(uuid.UUID(bytes=n)) for n in names}
    assert {warc_bundles.record_id(p, warc_bundles.base32_sha1((h or "").encode())) for p, _, h in pages} <= responses
    got = sorted(warc_bundles.read_bundles(manifest, with_payload=True).collect(), key=repr)
    assert len(got) == len(pages)
    first = {"same": 1, "": 2, "other": 6, "é" * 50_000: 5}
    for r in got:
        html = next((h or "") for p, _, h in pages if p == r.page_id)
        digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        revisit = r.page_id is not None and r.page_id > first[html]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(html.encode()), digest, "revisit" if revisit else "response", first[html] if revisit else None)
        assert bytes(r.payload) == (b"" if revisit else html.encode())
    large = warc_bundles.archive_and_read(df, least=10).collect()
    assert sum(r.record_type == "revisit" for r in large) == 0
    assert warc_bundles.archive_and_read(df.limit(0)).count() == 0


def test_a_bundle_is_seekable_zstandard():
    out = io.BytesIO()
    bundle = warc_bundles.Bundle(out, frame_bytes=500)
    names, payloads = [], [bytes([65 + i]) * 100 * i for i in range(9)]
    for i, p in enumerate(payloads):
        name, data = warc_bundles.record(i, f"http://x/{i}", p, warc_bundles.base32_sha1(p), None, "2020-01-01T00:00:00Z")
        names.append(name)
        bundle.add(name, data)
    bundle.close()
    raw = out.getvalue()
    reader = warc_bundles.BundleReader(io.BytesIO(raw))
    assert len(reader.frames) > 2
    for n, p in zip(names, payloads):
        assert reader.fetch(n)[1] == p
    with pytest.raises(KeyError):
        reader.fetch(warc_bundles.record_id(99, "x"))
    # any Zstandard reader sees the frames one after the other and skips the tables
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == 9
    with pytest.raises(ValueError):
        warc_bundles.BundleReader(io.BytesIO(raw[:-1]))


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "html,want",
    [
        (None, ""),
        ("", ""),
        ("<p></p>", ""),
        (page("<nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>One\n two.<br>Three &lt;x&gt; four.</p></article><footer>&copy; me</footer>"), "A & B One two. Three <x> four."),
        (page("<article><p>Text <b>bo</b>ld <a href=y>link</a> here.</p><aside>Side bar text that is long enough to look real.</aside><p>End.</p></article>"), "Text bold link here. End."),
        (page('<div class="cookie-notice"><p>We use cookies. Please accept all of them, dear reader.</p></div><main><p>Real words of the story.</p><div id="comments"><p>First! What a great long comment this is.</p></div></main>'), "Real words of the story."),
        (page("<article><script>if (a < b) { x('</p>') }</script><style>p{}</style><p>Kept.</p><form><label>Name</label><input></form><!-- <p>not</p> --></article>"), "Kept."),
        (page("<article><p>An unfinished page with a p"), "An unfinished page with a p"),
        ("<html><body><article><p>Cut in a tag <p class=", "Cut in a tag"),
        (page("<article><p>1 < 2 and a<b</p></article>"), "1 < 2 and a"),
        (page('<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p hidden>no</p><p style="display: none">no</p><p>Yes.</p></article>'), "Title Yes."),
    ],
)
def test_page_text(html, want):
    assert html_mincut.main_text(html) == want


@pytest.mark.parametrize("wrapper", ['div class="has-sidebar"', 'div class="layout with-sidebar"', 'div class="no-comments"', 'div class="site-content menu-open"', 'div class="toc-enabled"', 'div class="main share-enabled"', 'div class="legal-case"', 'main class="site-main has-sidebar"', 'div class="content-sidebar-wrap"', 'form id="aspnetForm"', 'div class="sidebar"', "div"])
def test_wrappers_keep_the_article(wrapper):
    story = "A long run of plain words that goes on, as stories do. "
    rest = '<div class="sidebar"><p>Some side text that is rather long, with commas.</p></div><section id="comments"><article><p>A first comment, long enough to look real.</p></article></section>'
    html = page(f"<nav><a href=x>Home</a></nav><{wrapper}><article class='post no-comments'><h1>Title</h1><p>{story * 5}</p><p>Short.</p></article></{wrapper.split()[0]}>{rest}<footer><article>Read also this other story of ours.</article></footer>")
    assert html_mincut.main_text(html) == f"Title {(story * 5).strip()} Short."


PLAIN = [
    "<div><a href=a>One</a> <a href=b>Two</a></div><div><h2>Head</h2><p>{0}</p><p><a href=c>See this</a></p><p>{0}</p><p>{0}</p></div><div><a href=d>Imprint</a></div>",
    "<div id=menu><p>{0}</p></div><div class=post-body><p>{0}</p><p>Yes</p><p>{0}</p><p>© me</p></div><div class='share-links'><p>Send it</p></div>",
    "<table><tr><td><a href=x>A</a><td><p>{0}<p>No<p>{0}</table><p>{0}",
]


def test_pages_without_tags_equal_the_enumerated_cut():
    """Whole pages: text is what the cheapest of all labellings keeps; the cut turns some blocks."""
    turned = total = 0
    for html in PLAIN:
        found = html_mincut.blocks(html.format("A sentence of some plain words, long enough to be read. " * 3))
        unary, keep = html_mincut.label(found)
        edges = html_mincut.smoothness([b[1] for b in found])
        cost = lambda k: sum(max(0, z) * (not x) + max(0, -z) * x for z, x in zip(unary, k)) + sum(c for i, j, c in edges if k[i] != k[j])  # noqa: B023, E731
        best = min(itertools.product([False, True], repeat=len(found)), key=cost)
        assert keep == list(best) and html_mincut.main_text(html.format("A sentence of some plain words, long enough to be read. " * 3)) == " ".join(b[0] for b, k in zip(found, best) if k)
        turned, total = turned + sum((z > 0) != k for z, k in zip(unary, keep)), total + len(found)
    print(f"the cut turned {turned} of {total} blocks")
    assert 0 < turned < total


def test_query_equals_articles(spark):
    """The whole query on the tables, whose pages have one article each: its blocks, in order."""
    sf = "/root/testdata/sf0.001"
    got = {r.page_id: r for r in QUERIES["op8_html_mincut"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        want = " ".join(text for text, node, _ in html_mincut.blocks(r.html) if node.in_content)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_fitted_weights(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = html_mincut.fit_weights(pages, max_pages=60)
    assert len(weights) == len(html_mincut.UNFITTED) and weights != html_mincut.UNFITTED
    assert weights[2] < 0 < weights[1]  # links speak against content, length for it
    bare = "<body><div><a href=a>One</a> <a href=b>Two</a></div><div>" + "A long run of plain words. " * 20 + "</div></body>"
    assert html_mincut.main_text(bare, weights) == ("A long run of plain words. " * 20).strip()
    # weights decide where tags say nothing
    assert html_mincut.main_text(bare, tuple(-w for w in weights)) != html_mincut.main_text(bare, weights)
    assert html_mincut.fit_weights(pages.limit(0)) == html_mincut.UNFITTED
    assert html_mincut.extract(pages.limit(0)).count() == 0


def test_minimum_cut_is_minimal():
    rnd = random.Random(6)
    for _ in range(40):
        n = rnd.randrange(1, 8)
        unary = [rnd.choice([-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]) for _ in range(n)]
        edges = [(i, j, rnd.choice([0.2, 0.5, 1.5])) for i in range(n) for j in range(i) if rnd.random() < 0.5]
        cost = lambda keep: sum(max(0, z) * (not k) + max(0, -z) * k for z, k in zip(unary, keep)) + sum(c for i, j, c in edges if keep[i] != keep[j])
        best = min(cost(k) for k in itertools.product([False, True], repeat=n))
        assert abs(cost(html_mincut.minimum_cut(unary, edges)) - best) < 1e-6


def test_pages_as_rows(spark):
    rows = [(1, "u", page("<article><p>Hi é.</p></article>"), 1, "x"), (1, None, None, 1, "x"), (None, "v", "<p>", 1, "x")]
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in html_mincut.extract(spark.createDataFrame(rows, PAGES)).collect())
    assert got == [(0, "v", "", 0), (1, "", "", 0), (1, "u", "Hi é.", 5)]
    long = "<div>" * 3000 + "<p>deep words</p>"
    assert isinstance(html_mincut.main_text(long), str)


CHAT = "conv_id long, turn long, role string, text string, kind string, idx int"
TOOLS = [("add", "x", "number", True), ("add", "y", "number", False)]


def chats(spark, rows, **how):
    schemas = spark.createDataFrame(TOOLS, "name string, param string, type string, required boolean")
    df = spark.createDataFrame([(*r, "clash", 9) for r in rows], CHAT)
    return chat_tools.format_chats(df, schemas, exchanges=False, **how).orderBy("conv_id", "position").collect()


def test_tool_calls(spark):
    calls = '{"tool_calls":[{"id":"b","name":"add","arguments":{"y":2,"x":1.50},"depends_on":["a"]},{"id":"a","name":"add","arguments":"{\\"x\\":\\"no\\",\\"z\\":1}"},{"id":"a","name":"add","arguments":{"x":1}},{"id":"c","name":"sub","arguments":[1]}]}'
    rows = [(1, 0, "system", "Be nice"), (1, 1, "user", "hi"), (1, 2, "assistant", calls), (1, 4, "tool", '{"tool_call_id":"b","content":"5"}'), (1, 1, "tool", '{"tool_call_id":"a","content":{"k":1}}'), (1, 5, "tool", '{"tool_call_id":"zz"}'), (1, 6, "tool", '{"tool_call_id":"b","content":"6"}')]
    got = chats(spark, rows)
    assert [r.position for r in got] == list(range(len(got)))
    seen = [(r.kind, r.call_id, r.status, r.partner_turn, r.errors) for r in got]
    assert seen == [
        ("message", None, None, None, None), ("message", None, None, None, None), ("call", "a", "linked", 1, ["type x", "unexpected z"]), ("call", "a", "repeated", None, []), ("call", "c", "no result", None, ["unknown tool"]),
        ("result", "a", "linked", 2, None), ("call", "b", "linked", 4, []), ("result", "b", "linked", 2, None), ("result", "zz", "no call", None, None), ("result", "b", "repeated", None, None),
    ]
    assert got[6].json == '{"arguments":{"x":1.5,"y":2},"id":"b","name":"add","type":"call"}'


def test_cycles_nulls_and_repeats(spark):
    loop = '{"tool_calls":[{"id":"p","name":"add","arguments":{"x":1},"depends_on":["q"]},{"id":"q","name":"add","arguments":{"x":1},"depends_on":["p"]},{"id":"ok","name":"add","arguments":{}}]}'
    got = {(r.conv_id, r.call_id): r for r in chats(spark, [(2, 0, "assistant", loop)])}
    assert {k[1]: r.status for k, r in got.items()} == {"p": "cyclic", "q": "cyclic", "ok": "no result"}
    assert got[2, "ok"].errors == ["missing x"] and not got[2, "ok"].valid
    odd = chats(spark, [(None, None, None, None), (3, 0, "user", ""), (3, 0, "user", ""), (3, None, "tool", None), (3, 1, "assistant", "{broken")])
    assert len(odd) == 5 and [r.position for r in odd if r.conv_id == 3] == [0, 1, 2, 3]
    assert chats(spark, []) == []


def brute_settle(calls):
    """{id: (at_turn, level)} of the calls of a conversation that can be put in order."""
    known, done = {c[0]: c for c in calls}, {}
    while True:
        ready = [c for c in calls if c[0] not in done and all(n in done for n in c[3] if n in known)]
        if not ready:
            return done
        for i, turn, idx, needs in ready:
            last = max(((*done[n], known[n][1], known[n][2]) for n in needs if n in known), default=None)
            done[i] = last[:2] if last and last >= (turn, 0, turn, idx) else (turn, 0)
            if last and last >= (turn, 0, turn, idx):
                done[i] = last[0], last[1] + 1


def test_order_of_random_call_graphs(spark):
    """Whole conversations against a plain ordering: positions, links, cycles, unknown needs."""
    rnd = random.Random(12)
    rows, graphs = [], {}
    for conv in range(60):
        calls, n = [], rnd.randrange(1, 8)
        for k in range(n):
            needs = sorted({f"c{rnd.randrange(n + 1)}" for _ in range(rnd.choice([0, 0, 1, 1, 2]))}) if rnd.random() < 0.8 else []
            calls.append((f"c{k}", rnd.randrange(0, 6), needs))
        turns = {}
        for c in calls:
            turns.setdefault(c[1], []).append(c)
        listed = []
        for turn, own in turns.items():
            listed += [(i, turn, idx, needs) for idx, (i, _, needs) in enumerate(own)]
            rows.append((conv, turn, "assistant", json.dumps({"tool_calls": [{"id": i, "name": "add", "arguments": {"x": 1}, "depends_on": needs} for i, _, needs in own]})))
        answered = {i for i, *_ in listed if rnd.random() < 0.7}
        rows += [(conv, rnd.randrange(0, 8), "tool", json.dumps({"tool_call_id": i, "content": "r"})) for i in sorted(answered)]
        graphs[conv] = listed, answered
    got = chats(spark, rows)
    for conv, (listed, answered) in graphs.items():
        mine = [r for r in got if r.conv_id == conv]
        settled = brute_settle(listed)
        known = {c[0] for c in listed}
        assert [r.position for r in mine] == list(range(len(mine)))
        at = {r.call_id: r.position for r in mine if r.kind == "call"}
        for i, turn, idx, needs in listed:
            row = next(r for r in mine if r.kind == "call" and r.call_id == i)
            assert row.status == ("cyclic" if i not in settled else "linked" if i in answered else "no result")
            assert row.errors == [f"unknown dependency {n}" for n in sorted(set(needs) - known)]
            if i in settled:
                assert all(at[n] < at[i] for n in needs if n in known)
        order = sorted((i for i in at if i in settled), key=lambda i: (*settled[i], *next((c[1], c[2]) for c in listed if c[0] == i)))
        assert sorted(order, key=at.get) == order
        for r in mine:
            if r.kind == "result":
                assert r.status == "linked" and r.position > at[r.call_id]


def test_one_cycle_among_many_lifted_conversations(spark):
    """Rounds follow the longest chain of needs, not the number of conversations or cycles."""
    rows = [(c, i, turn, 0, needs) for c in range(10_000) for i, turn, needs in (("a", 0, ["b"]), ("b", 1, ["d"]), ("d", 2, []))]
    rows += [(10_000, "p", 0, 0, ["q"]), (10_000, "q", 0, 1, ["p"]), (10_001, "s", 0, 0, ["s"])]
    df = spark.createDataFrame(rows, "conv_id long, call_id string, turn long, idx int, depends_on array<string>")
    found, rounds = chat_tools.settle(df)
    assert rounds <= 3 + 2
    kinds = found.groupBy("call_id", "at_turn", "level", "cyclic").count().collect()
    assert {(r.call_id, r.at_turn, r.level, r.cyclic): r["count"] for r in kinds} == {("d", 2, 0, False): 10_000, ("b", 2, 1, False): 10_000, ("a", 2, 2, False): 10_000, ("p", 0, 0, True): 1, ("q", 0, 0, True): 1, ("s", 0, 0, True): 1}


def test_no_assistant_turn_is_lost(spark):
    rows = [(1, 0, "assistant", '{"tool_calls": []}'), (1, 1, "assistant", '{"tool_calls": "x"}'), (1, 2, "assistant", '\n {"content":"I call.","tool_calls":[{"id":"a","name":"add","arguments":{"x":1}}]}'), (1, 3, "assistant", '{"tool_calls":[{"name":"add","arguments":{"x":1}}, null]}'), (1, 4, "assistant", '{"tool_calls":[null]}')]
    got = [(r.turn, r.kind, r.status, r.call_id) for r in chats(spark, rows)]
    assert got == [(0, "message", None, None), (1, "message", None, None), (2, "message", None, None), (2, "call", "no result", "a"), (3, "call", "no identifier", None), (4, "message", None, None)]


def test_item_types_and_allowed_values(spark):
    schemas = spark.createDataFrame([("f", "k", "array<integer>", True, None), ("f", "u", "string", False, ["c", "f"])], "name string, param string, type string, required boolean, allowed array<string>")
    text = json.dumps({"tool_calls": [{"id": str(i), "name": "f", "arguments": a} for i, a in enumerate([{"k": [1, 2]}, {"k": []}, {"k": ["x"], "u": "c"}, {"k": [1], "u": "z"}])]})
    df = spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string")
    got = {r.call_id: r.errors for r in chat_tools.format_chats(df, schemas, exchanges=False).collect()}
    assert got == {"0": [], "1": [], "2": ["type k"], "3": ["value u"]}


def test_exchanges_are_linked(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = {(r.conv_id, r.turn): r for r in df.collect()}
    got = chat_tools.format_chats(df).collect()
    assert len(got) == len(rows)
    for r in got:
        role = rows[r.conv_id, r.turn].role
        after = rows.get((r.conv_id, r.turn + 1))
        before = rows.get((r.conv_id, r.turn - 1))
        if role == "user":
            assert r.kind == "call" and r.valid and r.status == ("linked" if after and after.role == "assistant" else "no result")
        elif role == "assistant":
            assert r.kind == "result" and r.status == ("linked" if before and before.role == "user" else "no call")
        else:
            assert r.kind == "message"
    for _, turns in itertools.groupby(sorted(got, key=lambda r: (r.conv_id, r.position)), lambda r: r.conv_id):
        turns = list(turns)
        assert [r.position for r in turns] == list(range(len(turns))) and [r.turn for r in turns] == sorted(r.turn for r in turns)


def test_pipeline_decides_by_row(spark):
    """Ids that are null or shared by different texts: only the row that is a copy, or contaminated, goes."""
    sf = "/root/testdata/sf0.01"
    item = max((r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()), key=len)
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    leak = f"{text('before')} {item} {text('after')}"
    rows = [(None, leak), (None, text("a")), (1, leak), (1, text("b")), (2, text("c"))]
    assert left(corpus_pipeline.decontaminated(spark, frame(rows), sf)) == sorted([rows[1], rows[3], rows[4]], key=repr)
    rows = [(3, text("d")), (5, text("d")), (5, text("e")), (5, text("e")), (6, text("f")), (6, text("f") + " more"), (None, text("d")), (7, None)]
    got = left(corpus_pipeline.unique(spark, frame(rows), sf))
    assert [x for x in got if x[0] != 6] == sorted([rows[0], rows[2], rows[6], rows[7]], key=repr) and sum(x[0] == 6 for x in got) == 1


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    base = " ".join(f"base{i}" for i in range(80))
    planted = [(10**6, base, "en", "s", 1), (10**6 + 1, base + " more", "en", "s", 1), (10**6 + 2, "123 456 !!", "en", "s", 1), (10**6 + 3, None, None, None, None)]
    docs = docs.union(spark.createDataFrame(planted, docs.schema))
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf)
        docs.write.parquet(str(tmp_path / stage.__name__))
        docs = spark.read.parquet(str(tmp_path / stage.__name__))
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        if stage is not corpus_pipeline.tokens:
            assert docs.columns == before.columns == corpus_pipeline.COLUMNS
        if stage is corpus_pipeline.unique:
            groups = {r.doc_id: r.component_id for r in ngram_join.link_components(before).collect()}
            assert kept[-1] == set(groups.values())
            clean_texts = {r.doc_id: r.text for r in docs.collect()}
    assert {10**6, 10**6 + 1} <= kept[0] and not {10**6 + 2, 10**6 + 3} & kept[0]
    assert 10**6 in kept[2] and 10**6 + 1 not in kept[2]
    leaks = {d for d, t in clean_texts.items() if any(i in t for i in items)}
    assert leaks and not leaks & kept[3] and kept[3] == kept[4]
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = kept[0] - kept[1]
    assert sum(toxic.get(d) == 0 for d in gone) <= 2
