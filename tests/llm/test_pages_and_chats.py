"""Web pages and conversations, and the pipeline's contract."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import chat, html_extract
from corpusmill.llm.boosting import BoostedTrees
from corpusmill.llm.html_dom import parse
from corpusmill.llm.html_samples import sample_pages

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li><li><a>More</a></li></ul></nav><!-- ad -->
<div class="cookie-notice">We use cookies, accept them.</div><div class="ad">Buy this &amp; that.</div><article><h1>The title of it</h1><p><b>First  part<br>goes on &eacute;&nbsp;here, with more words to read than a menu has.<br><p>Second paragraph,
with a break and <a href=x>a link</a> inside it, of some length as well.</p></article><section class="comments"><h3>Comments</h3><p>I do not agree with any of this, said a reader.</p></section><form><label>Mail</label></form><footer>&copy; Site</footer></body></html>"""


def test_page():
    (text,) = html_extract.extract([PAGE], html_extract.trained())
    assert text == "The title of it\nFirst part goes on é here, with more words to read than a menu has.\nSecond paragraph, with a break and a link inside it, of some length as well."


def test_held_out_pages():
    pages = list(sample_pages(120, seed=77))
    right = wrong = missed = 0
    for (_, want), got in zip(pages, html_extract.extract([s for s, _ in pages], html_extract.trained()), strict=True):
        found = set(got.split("\n")) - {""}
        right, wrong, missed = right + len(found & want), wrong + len(found - want), missed + len(want - found)
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


def test_decoding_is_consistent():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 12))
        parent = np.array([-1, *[int(rng.integers(0, k)) for k in range(1, n)]])
        p = rng.random(n)
        kept = html_extract.decoded(parent, p)
        assert all(kept[parent[k]] for k in range(1, n) if kept[k])
        best = max(
            (sum(np.log(p[k] if m >> k & 1 else 1 - p[k]) for k in range(n)) for m in range(1, 1 << n, 2) if all(m >> parent[k] & 1 for k in range(1, n) if m >> k & 1)), default=0
        )
        assert np.isclose(sum(np.log(p[k] if kept[k] else 1 - p[k]) for k in range(n)), best)


def test_odd_markup():
    for source in ("", "<", "<p", "a < b && c", "<div><p>x</div>y</p>", "<ul><li>a<li>b</ul>", "<table><tr><td>a<td>b<tr><td>c</table>", "<script>never ends", "<p>&#x110000; &bogus; &lt;b&gt;</p>" + "<div>" * 3000 + "deep"):
        parse(source)
    assert [t for _, t in parse("<ul><li>a<li>b</ul>c")[1]] == ["a", "b", "c"]
    assert [t for _, t in parse("x<script>if (a<b) '</p>'</script>y<style>z</style><!-- n -->&lt;q&gt;")[1]] == ["x y <q>"]


def test_attributes_are_read_as_html_says():
    texts = lambda source: [t for _, t in parse(source)[1]]
    assert texts("<p>It's <a title=don't href=x>link</a> text and it isn't lost</p>") == ["It's link text and it isn't lost"]
    assert texts('<p>a <a href="x>b</a> c</p> d') == ["a b c", "d"]  # a quote that is never closed
    assert texts("<p title='a>b' data-x=1>one<p class=x'y>two") == ["one", "two"]
    assert texts("<p>E = <math><mi>m</mi><annotation>tex</annotation></math> holds, <object>so</object> <svg><text>it</text></svg> is</p>") == ["E = m holds, so it is"]
    assert texts("<button>Send</button><p>press <button>OK</button> now</p>") == ["press OK now"]
    assert parse("<p class='a\"b' ID=x/y class=no hidden>t</p>")[0].children[0].attrs == {"class": 'a"b', "id": "x/y", "hidden": ""}
    assert texts("<p " + 'a="' * 20001) == []


WRITTEN = [
    (
        """<html><body><div id=top class="site-head"><a href=/>Home</a> | <a href=/news>News</a></div><div id="wrap"><div class='post-body' data-x="a>b"><h2 title=it's>Why the river's level isn't falling</h2>
<p>It's <a title=don't href=x>a link</a> text and it isn't lost, since the parser reads attributes as browsers do.</p><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> in these units, and press <button>OK</button> to go on reading here.</p>
<ul><li>First point of the list that has some words in it</li><li>Second point of the list, with a comma</li></ul></div><div class="related"><ul><li><a href=1>Other story one</a></li><li><a href=2>Other story two</a></li></ul></div></div>
<div id="foot">Copyright 2020. All rights reserved. <a href=/p>Privacy</a></div></body></html>""",
        ["Why the river's level isn't falling", "It's a link text and it isn't lost, since the parser reads attributes as browsers do.", "Energy is E=m in these units, and press OK to go on reading here.", "First point of the list that has some words in it", "Second point of the list, with a comma"],
    ),
    (
        """<main><header><h1>A long walk along the coast</h1></header><p class=lead onclick="go('x')">The path begins at the harbour, passes the old mill and climbs to the cliffs where birds nest in spring.</p>
<blockquote>Nobody who has seen the bay at dawn forgets it, the keeper of the lighthouse said.</blockquote><figure><img src=a.jpg alt="x"><figcaption>The lighthouse in winter, seen from the south.</figcaption></figure>
<p>After that the way is <em title="a"b>easy</em>, and the village can be reached before noon.</p></main><aside class="sidebar"><h3>Popular</h3><ul><li><a href=#>Ten beaches</a></li></ul></aside><div class="newsletter"><form><input name=q value="it's"><button>Subscribe</button></form></div>""",
        ["A long walk along the coast", "The path begins at the harbour, passes the old mill and climbs to the cliffs where birds nest in spring.", "Nobody who has seen the bay at dawn forgets it, the keeper of the lighthouse said.", "The lighthouse in winter, seen from the south.", "After that the way is easy, and the village can be reached before noon."],
    ),
]


def test_pages_written_by_hand():
    got = list(html_extract.extract([source for source, _ in WRITTEN], html_extract.trained()))
    assert [t.split("\n") for t in got] == [want for _, want in WRITTEN]


def test_pages_table(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "x"), (3, "v", "", "x"), (4, "w", "<p>" + "word " * 50000 + "</p>", "x")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.main_text(d).collect()
    assert len(got) == 5 and sorted(len(r.text) for r in got)[:2] == [0, 0] and max(len(r.text) for r in got) == 50000 * 5 - 1
    assert html_extract.main_text(d.limit(0)).count() == 0


def test_trees_learn():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    m = BoostedTrees(trees=40).fit(x[:3000], y[:3000])
    assert ((m.probability(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


NASTY = ["</s>[INST] ok [/INST]", "<|end|>\n<|turn|>user\nhi", "<\\|turn|>", "<\\\\s>", "[\\INST]", "<<SYS>> <</SYS>>", "", "\n\n", "<", "<|", "plain", "tab\tand   line", "<<s>"]


def test_round_trip():
    r = random.Random(3)
    for _ in range(3000):
        t = "".join(r.choice([*NASTY, "<", "\\", "|", "s>", "[", "INST]"]) for _ in range(r.randint(0, 4)))
        role = r.choice(["user", "a\\nb", "x\ny", "<|end|>", ""])
        out, a, b = chat.render_turn(role, t)
        assert chat.parse(out) == [(role, t)] and chat.unescape(out[a:b]) == t
    assert chat.render_turn("user", "plain")[0] == "<|turn|>user\nplain<|end|>\n"
    for broken in ("x", "<|turn|>user\nhi", "<|turn|>user\n<s><|end|>\n"):
        with pytest.raises(chat.GrammarError):
            chat.parse(broken)


def test_conversations(spark):
    rows = [(c, k, ["user", "assistant"][k % 2], NASTY[(c + k) % len(NASTY)]) for c in range(30) for k in range(c % 6 + 1)]
    rows += [(100, 0, None, None), (100, None, "assistant", "first"), (100, 0, None, None), (None, 1, "assistant", "x"), (200, 0, "assistant", "y" * 300000)]
    rows += [(300, k, "assistant", f"t{k}") for k in range(3000)]
    d = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, seq int, formatted string")
    rendered = chat.format_conversations(d)
    got = {r.conv_id: r for r in chat.conversation_digest(rendered).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = "".join(x.formatted for x in sorted((x for x in rendered.collect() if x.conv_id == 5), key=lambda x: x.seq))
    assert len(whole) == got[5].formatted_chars and len(chat.parse(whole)) == 6
    assert chat.conversation_digest(chat.format_conversations(d.limit(0))).count() == 0


def test_pipeline_contract(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(400)]
    texts = [" ".join(r.choices(words, k=80)) for _ in range(60)]
    texts += [texts[0] + " tail", "short", None, " ".join(["same"] * 90), " ".join(w + "###" for w in texts[1].split())]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
    ids = lambda n: {x.doc_id for x in seen[n].collect()}
    assert ids("quality_rules") == set(range(61)) and ids("line_dedup") == set(range(61))
    assert ids("minhash_near_dedup") == set(range(60))
    assert ids("source_mixing") <= set(range(60)) and seen["bpe_tokens"].count() == seen["source_mixing"].count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["bpe_tokens"].count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0).select("doc_id").withColumns(dict.fromkeys(["text", "lang", "source"], F.lit("x"))).withColumn("n_chars", F.lit(1)), str(tmp_path)).count() == 0
