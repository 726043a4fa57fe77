"""HTML extraction on hand-written pages, role repair against all repairs."""

import time
from itertools import product

import pytest

from motley.llm import chat, html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header class="site"><a href="/">Home</a> Our site</header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<div class="cookie-notice">We use cookies. <button>OK</button></div>
<main><article><h1>A title &amp; more</h1><p>First <b>bold</b> paragraph,<br>with a break&nbsp;here and some more words in it.<p>Second &lt;paragraph&gt; of the
article without an end tag, long enough to be prose.<script>var t = "</p>";</script>
<ul><li>An item of a list in the article.</li></ul><div class="ad">Buy now!</div><p>Last one.</p></article></main>
<aside class="sidebar"><h3>Related</h3><p>Another story that you may like a lot, with many words.</p></aside>
<form><label>Name</label><input name="n"><textarea>x</textarea></form>
<section id="comments"><p>Great article, I liked it very much, thank you for it.</p></section>
<footer>&copy; example.com &middot; Imprint</footer></body></html>"""


def test_article_only():
    assert html.main_text(PAGE) == "A title & more\nFirst bold paragraph, with a break here and some more words in it.\nSecond <paragraph> of the article without an end tag, long enough to be prose.\nAn item of a list in the article.\nLast one."


def test_broken_pages():
    assert html.main_text(None) == html.main_text("") == html.main_text("<!-- never closed <p>x</p>") == ""
    assert html.main_text("<article><p>Cut off in the mid") == "Cut off in the mid"
    assert html.main_text("<article><p>a < b and 3 > 2 holds.</p></article>") == "a < b and 3 > 2 holds."
    assert html.main_text("<body><script>no end") == ""


def test_minimum_cut_is_least():
    values, parents = [2.0, -0.5, 1.0, -3.0, 0.2, -0.1], [1, 1, 1, 2, 2, 1]

    def cost(labels):
        total, latest = 0.0, {}
        for k, (v, p) in enumerate(zip(values, parents)):
            total += abs(v) * (labels[k] != (v > 0))
            total += html.ADJACENT * (k > 0 and labels[k] != labels[k - 1])
            if p in latest:
                total += html.SIBLING / (k - latest[p]) * (labels[k] != labels[latest[p]])
            latest[p] = k
        return total

    assert cost(html.cut(values, parents)) == pytest.approx(min(map(cost, product([False, True], repeat=6))))


def test_cut_equals_max_flow():
    """Deciding certain blocks first changes no label."""
    import random

    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 14)
        values, parents = [rng.uniform(-3, 3) for _ in range(n)], [rng.randint(1, 4) for _ in range(n)]
        edges, latest = [], {}
        for k, p in enumerate(parents):
            edges += [(k - 1, k, html.ADJACENT)] if k else []
            edges += [(latest[p], k, html.SIBLING / (k - latest[p]))] if p in latest else []
            latest[p] = k

        def cost(labels):
            return sum(abs(v) * (keep != (v > 0)) for v, keep in zip(values, labels)) + sum(w * (labels[a] != labels[b]) for a, b, w in edges)

        labels = html.cut(values, parents)
        assert labels == html.max_flow(values, edges)
        assert cost(labels) == pytest.approx(min(map(cost, product([False, True], repeat=n)))) if n <= 10 else True


def test_classifier_and_cut_on_unseen_pages():
    w, wrong, flipped, count = html.weights(), 0, 0, 0
    for page, labels in html.generated(150, 5):
        found = html.labelled(page, w)
        assert len(found) == len(labels)
        count += len(labels)
        wrong += sum(keep != label for (_, _, keep), label in zip(found, labels))
        flipped += sum((odds > 0) != keep for _, odds, keep in found)
    assert flipped > 0 and wrong < 0.02 * count


def test_marks_and_raw_elements():
    assert html.main_text("<p>First one is a paragraph of prose.</p><script>if(a<b){x()} // it's</script><p>Second one, which isn't short at all.</p><p>Third one is prose too.</p>").count("\n") == 2
    assert html.main_text('<div class="main-content post meta"><p>A real paragraph with a good number of words in it, so there.</p></div>').startswith("A real")
    assert html.main_text('<article><div class="author-meta"><h1>The headline</h1></div><p>A real paragraph with a good number of words in it.</p></article>').startswith("The headline")
    assert html.main_text("<article><p>Before the list.</p><select><p>After something that is never closed.</p></article>").endswith("closed.")


def test_long_pages_take_linear_time():
    import time

    page = "<article>" + "".join(f"<p>Paragraph {k} has a few words of its own.</p>" + "<div>short</div>" * (k % 3) for k in range(50_000)) + "</article>"
    began = time.perf_counter()
    text = html.main_text(page)
    assert text.count("\n") >= 49_999 and time.perf_counter() - began < 60


@pytest.mark.parametrize("raw", ["<math><mi>x</mi></math>", "<svg><text>no</text></svg>", "<script>var a = '</p>'</script>", "<iframe src=x>no</iframe>", "<select><option>no</select>"])
def test_a_raw_element_does_not_end_its_paragraph(raw):
    assert html.main_text(f"<article><h1>A title</h1><p>The formula {raw} matters in this long enough sentence of prose.</p></article>") == "A title\nThe formula matters in this long enough sentence of prose."


@pytest.mark.parametrize("page", ["<div>" * 60_000 + "</section>" * 60_000, "<b>x" * 100_000, "<a><div>" + "<b>" * 60_000 + "</a>" * 60_000 + "x", "<ul>" + "<li><i>x" * 60_000])
def test_nested_pages_take_linear_time(page):
    began = time.perf_counter()
    html.blocks(page)
    assert time.perf_counter() - began < 10


def test_pages_query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = html.extract(pages).collect()
    assert len(out) == pages.count() and all(r["n_chars"] == len(r["text"]) and r["text"] for r in out)
    assert html.extract(pages.where("false")).count() == 0


def cheapest(codes):
    best = None
    steps = [(t, k) for t in (1, 2, 3, 4) for k in range(len(chat.STEPS[t]))]
    for way in product(steps, repeat=len(codes)):
        state, cost = 0, 0
        for (t, k), code in zip(way, codes):
            before, _, _, extra = chat.STEPS[t][k]
            if before != state:
                break
            state, cost = t, cost + extra + chat.relabel(code, t)
        else:
            cost += chat.INSERT * (state == chat.SYSTEM)
            best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("codes", [[1, 2, 3], [2, 2, 3], [3, 3], [1], [0, 0], [2, 1, 3], [3, 2], [1, 1, 2], [2, 3, 4, 3], [4, 2]])
def test_repair_is_cheapest(codes):
    state, cost = 0, 0
    for (action, after, inserted), code in zip(chat.repair(codes), codes):
        step = next(s for s in chat.STEPS[after] if s[0] == state and s[1] == action and s[2] == inserted)
        cost, state = cost + step[3] + chat.relabel(code, after), after
    assert cost + chat.INSERT * (state == chat.SYSTEM) == cheapest(codes)


ROLES = ["system", "user", "human", "assistant", None, "bot", "narrator", "assistant", "tool", "user", "user", "system"]


def rendered(rows):
    return "".join(r["rendered"] for r in sorted(rows, key=lambda r: (r["turn"] if r["turn"] is not None else -1, r["role"] or "")))


def test_parts_do_not_change_repairs(spark, monkeypatch):
    turns = spark.createDataFrame([(c, k, ROLES[(k * (c + 3)) % len(ROLES)], f"t{k}") for c in range(6) for k in range(25)], "conv_id long, turn long, role string, text string")
    whole = chat.format_chats(turns).collect()
    monkeypatch.setattr(chat, "PART", 3)
    parts = chat.format_chats(turns).collect()
    for c in range(6):
        a, b = [r for r in whole if r["conv_id"] == c], [r for r in parts if r["conv_id"] == c]
        assert len(a) == len(b) == 25
        assert rendered(a).count("<|end|>") == rendered(a).count("<|user|>") + rendered(a).count("<|assistant|>") + rendered(a).count("<|system|>") + rendered(a).count("<|tool|>")

        def cost(rows):
            total = 0
            for r in rows:
                code = chat.ALIASES.get((r["role"] or "").strip().lower(), 0)
                total += chat.relabel(code, chat.STATES.index(r["new_role"])) + {"merge": chat.MERGE, "insert": chat.INSERT}.get(r["action"], 0)
            return total

        assert cost(a) == cost(b)


def test_odd_turns(spark):
    turns = spark.createDataFrame([(None, None, None, None), (1, 0, "User", "hi"), (1, 0, "User", "hi"), (1, None, "assistant", "a"), (2, 5, "system", "only")], "conv_id long, turn long, role string, text string")
    out = chat.format_chats(turns).collect()
    assert len(out) == 5
    assert [(r["action"], r["rendered"]) for r in out if r["conv_id"] == 2] == [("relabel", "<|user|>\nonly\n<|end|>\n")]  # cheaper than an inserted turn
    assert chat.format_chats(turns.where("false")).count() == 0


def test_well_formed_turns_stay(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    out = chat.format_chats(turns)
    assert out.count() == turns.count() and out.where("action <> 'keep'").count() == 0
