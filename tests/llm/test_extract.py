"""Blocks of broken markup, gradients of the labeller, and whole pages."""

import random

import numpy as np

from pavement.llm import extract
from pavement.llm.blocks import Block, blocks


def texts(html):
    return [b.text for b in blocks(html)]


def test_blocks():
    assert blocks(None) == [] and blocks("") == []
    assert texts("<p>a <b>b</b>\n c<p>d&amp;e<br>f</div>g") == ["a b c", "d&e f", "g"]
    assert texts("<title>t</title><script>if(a<b){'</p>'}</script><style>p{}</style><p>x<!-- y --><p") == ["x"]
    assert texts("<ul><li>a<li>b</ul>c <a href='x>y'>d</a>") == ["a", "b", "c d"]
    assert texts("<p title=\"1 > 0\">q &#233;&nbsp;z</p>tail &am") == ["q é z", "tail &am"]
    assert blocks("<div class='Side-Bar'><p>x")[0].path == ("div", "side", "bar", "p")
    assert texts("<script>never closed <p>x</p>") == []
    # formulas and drawings belong to their paragraph; what stands in other containers is judged, not skipped
    assert texts("<p>Euler: <math><mi>e</mi><mo>=</mo><mn>1</mn></math> holds.</p>") == ["Euler: e=1 holds."]
    assert texts("<p>a <svg><title>t</title><g><text>b</text></g></svg> c<noscript><p>d</p></noscript><template>e</template>") == ["a b c", "d", "e"]
    assert texts("<object><p>f</p></object><p>g <math>h") == ["f", "g h"]
    assert texts("<p>i <select><option>no</select><iframe>no</iframe><textarea>no</textarea>j") == ["i j"]
    for odd in ("<" * 50_000, "<a " * 50_000, "<p>" * 50_000, "<!--" * 50_000, "<a \"" * 20_000, "&amp;" * 50_000):
        blocks(odd)  # linear


def test_gradient():
    draw = np.random.default_rng(0)
    model = extract.Labeller.new(3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x = draw.normal(size=(4, 2, extract.WIDTH)).astype(np.float64)
    mask = np.array([[1, 1], [1, 1], [1, 1], [1, 0]], float)
    y = (draw.random((4, 2)) > 0.5).astype(float)

    def loss():
        both = np.concatenate([model._run(x, mask, "f")[0], model._run(x, mask, "b")[0]], axis=2)
        p = 1 / (1 + np.exp(-(both @ model.p["o"] + model.p["c"])))
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    grad = model.gradient(x, mask, y)
    for name in model.NAMES:
        at = tuple(draw.integers(0, s) for s in model.p[name].shape)
        old, step = model.p[name][at], 1e-3
        model.p[name][at] = old + step
        up = loss()
        model.p[name][at] = old - step
        down = loss()
        model.p[name][at] = old
        assert abs((up - down) / (2 * step) - grad[name][at]) < 2e-3


def test_pages(spark):
    draw = random.Random(7)
    say = lambda n: " ".join("".join(draw.choice("aeilmnrst") for _ in range(draw.randrange(2, 8))) for _ in range(n)) + "."
    pages, want = [], {}
    for i in range(90):
        body = [say(6)] + [say(draw.randrange(20, 60)) for _ in range(4)]
        around = [say(8), say(5), say(12)]
        pages.append((i, f"<html><head><title>t</title></head><body><nav><ul><li><a href='/'>{say(1)}</a></ul></nav>"
                         f"<div class='ad'>{around[0]}</div><article><h1>{body[0]}</h1>" + "".join(f"<p>{b}" for b in body[1:])
                         + f"</article><aside>{around[1]}</aside><div class=comments><p>{around[2]}</div><footer>x</footer>", "u"))
        want[i] = "\n".join(body)
    pages += [(100, None, "u"), (101, "", None), (None, pages[0][1], "u"), (1, pages[1][1], "u")]
    df = spark.createDataFrame(pages, "page_id long, html string, _main string")
    found, name = extract.main_text(df, extract.train(df))
    rows = found.collect()
    right = [r[name].text == want[r.page_id] for r in rows if r.page_id in want]
    assert np.mean(right) > 0.95
    rest = {r.page_id: r[name].text for r in rows if r.page_id is not None and r.page_id >= 100}
    assert rest == {100: "", 101: ""} and len(rows) == 94
    assert extract.main_text(df.limit(0), extract.Labeller.new())[0].count() == 0


def test_model_round_trip():
    model = extract.Labeller.new(5)
    again = extract.Labeller.from_bytes(model.to_bytes())
    page = [[Block(("p",), "a b c.", 0), Block(("nav",), "x", 1)]]
    assert np.allclose(model.probability(page), again.probability(page))
