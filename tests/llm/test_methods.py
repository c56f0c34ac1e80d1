"""What the methods rest on, against brute force: page designs, alias graphs, likelihoods."""

import re

import numpy as np
import pytest

from mediarill.llm import main_text, quality, token_files, toxicity, url_filter

#: Hand-made pages of other makes than the given ones; blocks of the main text begin with ¶.
DESIGNS = {
    "article_all": """<html><body><nav><a href=/>Home</a><a href=/a>News</a></nav><article><h1>¶headline of the piece</h1><p>¶first paragraph which says a few words about a matter, and goes on for some time.</p><h2>¶part</h2><ul><li>¶one thing</li><li>¶another thing, longer than the first one</li></ul><blockquote>¶what somebody said once about it.</blockquote><pre>¶code here</pre><table><tr><th>¶year</th><th>¶sum</th></tr><tr><td>¶1999</td><td>¶12</td></tr></table><p>¶last words of it.</p></article><footer>All rights</footer></body></html>""",
    "main_h2": """<body><header><h1>Daily Site</h1><ul><li><a href=1>World</a></li><li><a href=2>Sport</a></li></ul></header><main><h2>¶A headline in a second level</h2><p>¶The council met on Tuesday to talk about the bridge, which has been closed for two years.</p><p>¶Nobody knew when it would open again, said the engineer in charge of the works.</p><ol><li>¶First step is done</li><li>¶Second step is not</li></ol><aside>Advertisement: buy a boat today</aside><p>¶It may take longer.</p></main><footer><p>© 2020 Daily Site. Contact us.</p></footer></body>""",
    "divs_plain": """<body><div><div><a href=/1>Start</a> | <a href=/2>Blog</a> | <a href=/3>Contact</a></div><div><h1>¶How to bake bread at home</h1><div>¶Bread needs flour, water, salt and time. Mix them well, and let the dough rest for an hour in a warm place.</div><div>¶Then fold it twice, wait again, and heat the oven as far as it goes.</div><h3>¶What you need</h3><ul><li>¶500 g of flour</li><li>¶350 g of water</li><li>¶a pinch of salt</li></ul><p>¶Bake it for forty minutes until it is brown, and leave it to cool before you cut it.</p></div><div><h4>Most read</h4><ul><li><a href=4>Ten cakes</a></li><li><a href=5>Soup for winter</a></li></ul></div><div><p>3 comments</p><div><b>Anna, 12.3.2021</b><p>I tried this and it was great, thank you!</p><a href=#>Reply</a></div><div><b>Tom, 14.3.2021</b><p>Mine did not rise, why?</p><a href=#>Reply</a></div></div><div>© 2021 Bread blog. <a href=/i>Imprint</a></div></div></body>""",
    "table_layout": """<html><body><table><tr><td><a href=/h>Home</a><br><a href=/p>Products</a><br><a href=/c>Contact</a></td><td><h1>¶The history of the mill</h1><p>¶The old mill was built in 1820 by two brothers who had come down the river.</p><p>¶It burned twice and was rebuilt both times, the second time of stone.</p><table><tr><td>¶1820</td><td>¶built</td></tr><tr><td>¶1850</td><td>¶first fire</td></tr></table><p>¶Today it is a museum, open in summer.</p></td></tr></table><p>Copyright 2003 by the museum</p></body></html>""",
    "invented": """<body><div class="zq-top"><span><a href=/>Log in</a> <a href=/s>Sign up</a></span></div><div class="kk3"><div class="vv-a"><h1>¶New rules for the harbour</h1><p>¶From next month on, boats longer than ten metres must use the northern entry, the harbour master says.</p><p>¶Smaller boats may use both. The fee stays what it was last year, with a discount for members of the club.</p><blockquote><p>¶We had too many near misses, and something had to be done.</p></blockquote><p>¶The rules hold until the works are done, which may take until autumn.</p></div><div class="vv-b"><h3>About the author</h3><p>Maria writes about the sea and the coast for several papers.</p></div><div class="vv-c"><a href=1>Related: Ferry late again</a><a href=2>Storm closes port</a></div></div><div class="zq-end">Terms of use. All rights reserved.</div></body>""",
    "section_cookie": """<html><body><div id="c-bar"><p>We use cookies to improve your visit.</p><button>Accept all</button></div><section><h2>¶Measuring rain</h2><p>¶A rain gauge is a simple tool: a funnel, a tube and a scale. It should stand free, away from trees and walls.</p><h3>¶Reading it</h3><p>¶Read the scale at the same hour each day, and empty the tube afterwards.</p><dl><dt>¶Light rain</dt><dd>¶less than two millimetres an hour</dd><dt>¶Heavy rain</dt><dd>¶more than ten millimetres an hour</dd></dl><pre>¶total = sum(days)</pre><p>¶Write the figures down and compare them over the years.</p></section><form><label>Your e-mail</label><input><button>Subscribe</button></form><footer><a href=1>Privacy</a> <a href=2>Contact</a></footer></body></html>""",
    "main_comments_box": """<body><main><h1>¶A walk in the hills</h1><p>¶We set out early and met nobody on the first stretch, which goes along the stream for an hour or so.</p><p>¶Above the trees the view opens to the south, and on clear days you see the lake.</p><p>¶The way back is shorter, but steep, and should be left alone when it is wet.</p><div><h3>2 Comments</h3><div><div>hiker22</div><p>Lovely trip, did it last year with my kids.</p><a href=#>Reply</a></div><div><div>bob</div><p>Is there water on the way?</p><a href=#>Reply</a></div></div></main></body>""",
    "german_blog": """<html lang=de><body><div id=kopf><h1><a href=/>Mein Garten</a></h1><p><a href=/a>Beete</a> <a href=/b>Bäume</a> <a href=/c>Kontakt</a></p></div><div id=mitte><div class=beitrag><h2>¶Tomaten im Topf ziehen</h2><p>¶Tomaten brauchen viel Licht, Wasser und einen warmen Platz an der Wand.</p><p>¶Ein großer Topf ist besser als ein kleiner, denn die Erde trocknet nicht so schnell aus.</p><h3>¶Wann gießen?</h3><ul><li>¶am Morgen</li><li>¶nie in der Sonne</li></ul><p>¶Wer das beachtet, erntet bis in den Herbst.</p></div><div class=rand><h4>Neueste Beiträge</h4><ul><li><a href=1>Rosen schneiden</a></li><li><a href=2>Rasen säen</a></li></ul></div></div><div id=fuss>Impressum, Datenschutz. Alle Rechte vorbehalten.</div></body></html>""",
    "deep_no_names": """<body><div><div><div><div><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li></ul></div><div><div><h1>¶Why the river turned green</h1><div><p>¶It was on a Monday that people first saw it: the river, usually brown, had turned a bright green over night.</p><p>¶Samples were taken at five places. None of them held anything harmful, the office said.</p><p>¶"It is a dye used to find leaks," an engineer explained, and it goes away by itself.</p><table><tr><td>¶Place</td><td>¶Value</td></tr><tr><td>¶Bridge</td><td>¶0.2</td></tr></table><p>¶By Thursday it was brown again.</p></div></div></div></div></div></div></body>""",
    "post_with_share": """<body><nav id=nav><a href=1>A</a><a href=2>B</a></nav><div class="post"><h1>¶Ten years of the choir</h1><div class="share"><a href=1>Share</a><a href=2>Tweet</a></div><p>¶The choir sang for the first time in a barn, in front of twelve people and a dog.</p><figure><img src=x><figcaption>¶The choir in the barn, 2012</figcaption></figure><p>¶Today it fills the town hall, and the tickets are gone in an hour.</p><div class="ad">Cheap flights to anywhere, book now!</div><ol><li>¶2012: the barn</li><li>¶2022: the hall</li></ol></div><div id="comments"><h3>Comments</h3><ul><li>Well done, all of you! I was there in the barn.</li><li>When is the next one?</li></ul></div><footer>Contact</footer></body>""",
}


@pytest.fixture(scope="module")
def labeller(spark, sf):
    return main_text.fit_labeller(spark.read.parquet(f"{sf}/pages.parquet"))


def judged(labeller, page):
    blocks = main_text.blocks_of(page)
    want = ["¶" in b.text for b in blocks]
    for b in blocks:
        b.text = b.text.replace("¶", "")
    return blocks, want, labeller.label([blocks])[0].tolist()


def test_other_page_designs(labeller):
    """At least 95 % of all blocks, and 70 % of those of each page."""
    right = total = 0
    for name, page in DESIGNS.items():
        _, want, got = judged(labeller, page)
        own = sum(a == b for a, b in zip(want, got, strict=True))
        assert own >= 0.7 * len(want), name
        right, total = right + own, total + len(want)
    assert right >= 0.95 * total


@pytest.mark.parametrize("box", ["article", "main"])
def test_all_kinds_of_blocks_in_a_main_part(labeller, box):
    texts = ["a headline of this page", "some words of a paragraph, which go on for a while and then end.", "short heading", "one item", "another item of the list", "somebody said this.", "x = y + 1", "year", "sum", "1999", "12", "a term", "what it means, in a few words.", "what the picture shows", "the last paragraph of it all."]
    forms = ["<h1>{}</h1>", "<p>{}</p>", "<h2>{}</h2>", "<ul><li>{}</li>", "<li>{}</li></ul>", "<blockquote>{}</blockquote>", "<pre>{}</pre>", "<table><tr><th>{}</th>", "<th>{}</th></tr>", "<tr><td>{}</td>", "<td>{}</td></tr></table>", "<dl><dt>{}</dt>", "<dd>{}</dd></dl>", "<figure><figcaption>{}</figcaption></figure>", "<p>{}</p>"]
    inside = "".join(f.format(t) for f, t in zip(forms, texts, strict=True))
    page = f"<body><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav><{box}>{inside}</{box}><footer>© all rights reserved</footer></body>"
    blocks = main_text.blocks_of(page)
    assert [b.text for b, y in zip(blocks, labeller.label([blocks])[0], strict=True) if y] == texts


def test_cdata_and_unclosed_parts():
    assert [b.text for b in main_text.blocks_of("<p>a &amp; b<![CDATA[ c &amp; d]]> e</p><![CDATA[hello world")] == ["a & b c &amp; d e", "hello world"]
    assert [b.text for b in main_text.blocks_of("<noscript>a<p>b<noscript>c")] == ["a", "bc"]


def test_deep_pages_take_linear_time():
    """A megabyte of unclosed elements: every block is there, and blocks share what they have in common."""
    blocks = main_text.blocks_of("<div>a" * 170_000)
    assert len(blocks) == 170_000 and len({id(b.path) for b in blocks}) == 1
    assert len(main_text.blocks_of("".join(f"<div class=c{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10 % 10]}>a" for k in range(20_000)))) == 20_000
    assert len(main_text.blocks_of("<noscript>a<p>" * 50_000)) == 50_000


def test_long_pages_are_read_in_pieces_alike(labeller):
    blocks = main_text.blocks_of("<body>" + "".join(f"<div><p>{'word ' * (k % 30)} end.</p><a href=x>link {k}</a></div>" for k in range(400)) + "</body>")
    one, two = labeller.label([blocks])[0], labeller.label([blocks], cells=1, piece=7)[0]
    assert (one == two).all()


# URLs.
def plain_verdicts(rows):
    """The contract by brute force: links by plain patterns, components by flooding, the longest rule."""
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)

    def parts(url):
        m = re.search("://([^/?#]*)([^?#]*)", url or "")
        return (lower(m[1]), m[2]) if m else ("", "")

    def node(url):
        bare = url.strip(" ").split("#")[0]
        m = re.match("[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", bare)
        return lower(m[0]) + bare[m.end() :] if m else bare

    def rule(url):
        host, path = parts(url)
        fits = [(len(h + p), len(h), a, h + p) for a, h, p in url_filter.RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (max(fits)[3], max(fits)[2]) if fits else (None, None)

    near = {}
    for _, url, html in rows:
        if url is None or "://" not in url:
            continue
        for pattern in ('rel="canonical" href="([^"]*)"', "content='0; url=([^']*)'"):
            for target in re.findall(pattern, html or ""):
                a, b = node(url), node(target)
                if a != b:
                    near.setdefault(a, set()).add(b)
                    near.setdefault(b, set()).add(a)
    group = {}
    for n in near:
        if n not in group:
            todo, met = [n], {n}
            while todo:
                for m in near[todo.pop()] - met:
                    met.add(m)
                    todo.append(m)
            actions = {rule(m)[1] for m in met} - {None}
            for m in met:
                group[m] = "allow" if "allow" in actions else "block" if actions else None
    out = []
    for page, url, _ in rows:
        name, action = rule(url)
        out.append((page, *parts(url), name, action or (group.get(node(url)) if url else None) or "allow"))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_url_verdicts_by_brute_force(spark, seed):
    """Chains, hubs and pairs of aliases over hosts with and without rules."""
    rng = np.random.default_rng(seed)
    hosts = ["a.net", "www.example.net", "example.com", "x.example.com", "x.org", "plain.example", "other.test", "EXAMPLE.net", "notexample.com"]
    paths = ["/en/1", "/de/2", "/fr/3", "/", "", "/de", "/en/?q=1"]
    free = [f"http://h{k}.test/p{k}" for k in range(40)]
    urls = free + [f"http://{h}{p}" for h in hosts for p in paths]
    rows = []
    for k in range(30):  # chains
        rows.append((len(rows), free[k], f'<link rel="canonical" href="{free[k + 1] if k % 6 else urls[int(rng.integers(len(urls)))]}">'))
    hub = urls[int(rng.integers(len(urls)))]
    for k in range(20):
        rows.append((len(rows), urls[int(rng.integers(len(urls)))], f"<meta http-equiv='refresh' content='0; url={hub}'>" if k % 2 else "<p>"))
    for _ in range(60):
        a, b = urls[int(rng.integers(len(urls)))], urls[int(rng.integers(len(urls)))]
        rows.append((len(rows), a + ("#x" if rng.random() < 0.2 else ""), f'<link rel="canonical" href="{b}">' if rng.random() < 0.3 else None))
    rows += [(len(rows), u, "") for u in (None, "nothing", "", "://x.net/")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = url_filter.judge_urls(df, url_filter.rules_table(spark, url_filter.RULES)).collect()
    want = plain_verdicts(rows)
    assert sorted(map(tuple, got), key=str) == want
    assert {w[4] for w in want if w[3] is None} == {"allow", "block"}  # aliases of both kinds


# Models.
def test_field_gradient_by_differences():
    """The step of training goes where the likelihood of the labelled chains rises."""
    rng = np.random.default_rng(2)
    lengths = np.array([5, 1, 70, 0, 3])
    odds, moves, gold = rng.normal(size=79), rng.normal(size=(2, 2)), (rng.random(79) < 0.4).astype(float)
    inner = np.ones(79, bool)
    inner[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
    at = np.flatnonzero(inner)

    def likelihood(odds, moves):
        score = (odds * gold).sum() + moves[gold[at - 1].astype(int), gold[at].astype(int)].sum()
        return score - toxicity.chain_marginals(odds, lengths, moves)[2]

    p, expected, _ = toxicity.chain_marginals(odds, lengths, moves)
    for i in (0, 5, 6, 40, 78):
        up, down = odds.copy(), odds.copy()
        up[i], down[i] = up[i] + 1e-5, down[i] - 1e-5
        assert gold[i] - p[i] == pytest.approx((likelihood(up, moves) - likelihood(down, moves)) / 2e-5, abs=1e-5)
    seen = np.zeros((2, 2))
    np.add.at(seen, (gold[at - 1].astype(int), gold[at].astype(int)), 1)
    for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)):
        up, down = moves.copy(), moves.copy()
        up[i, j], down[i, j] = up[i, j] + 1e-5, down[i, j] - 1e-5
        assert seen[i, j] - expected[i, j] == pytest.approx((likelihood(odds, up) - likelihood(odds, down)) / 2e-5, abs=1e-4)


def test_document_scores_by_brute_force():
    rng = np.random.default_rng(3)
    lengths = np.array([4, 0, 1, 9])
    p = rng.random(14)
    tagger = toxicity.Tagger(np.zeros(toxicity.SIZE), 0.0, np.zeros((2, 2)), np.array([-1.0, 0.5, 2.0, 1.0]))
    at, want = 0, []
    for n in lengths:
        own, at = p[at : at + n], at + n
        none = 1.0
        for x in own:
            none *= 1 - x
        z = -1.0 + 0.5 * np.log(1 + sum(own)) + 2.0 * (1 - none) + (max(own) if n else 0.0)
        want.append(1 / (1 + np.exp(-z)))
    assert np.allclose(tagger.scores(p, lengths), want)


def test_word_odds_are_sums_of_hashed_weights():
    rng = np.random.default_rng(1)
    tagger = toxicity.Tagger(rng.normal(size=toxicity.SIZE), 0.3, np.zeros((2, 2)), np.zeros(4))
    import zlib

    for w in ("", "a", "Stupid!", "größer", "“quoted”"):
        bare = w.lower().strip("\"'.,;:!?()[]{}<>|#$%&*+-=_~^/\\`@“”„«»…–—")
        names = {"=" + bare} | {"<" + bare[:n] for n in range(3, 7) if len(bare) >= n} | {">" + bare[-n:] for n in range(3, 6) if len(bare) >= n}
        assert tagger.odds(w) == pytest.approx(0.3 + sum(tagger.weights[zlib.crc32(f.encode()) % toxicity.SIZE] for f in names))


def test_quality_learns_from_every_labelled_document(spark):
    """Of 7,000 labelled documents those behind the first 4,000 by a hash of their ids are bad in a way of their own."""
    from pyspark.sql import functions as F

    from mediarill.llm.labelled import held_out

    ids = [r["doc_id"] for r in spark.range(9000).select(F.col("id").alias("doc_id")).where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id")).limit(7000).collect()]
    word = lambda k: f"word{k % 97}x"
    kinds = {"good": " ".join(map(word, range(20))), "short": "Ab cd", "signs": " ## ".join(map(word, range(20)))}
    rows = [(i, "signs" if k >= 4000 and k % 3 == 0 else "short" if k % 4 == 0 else "good") for k, i in enumerate(ids)]
    docs = spark.createDataFrame([(i, kinds[x]) for i, x in rows], "doc_id long, text string")
    ranker = quality.fit_quality(docs, spark.createDataFrame([(i, int(x == "good")) for i, x in rows], "doc_id long, quality int"))
    asked = spark.createDataFrame([(1, kinds["good"]), (2, kinds["short"]), (3, kinds["signs"])], "doc_id long, text string")
    assert {r["doc_id"]: r["score"] >= 0.3 for r in quality.rank_documents(asked, ranker).collect()} == {1: True, 2: False, 3: False}


def test_quality_sums_over_cells(spark):
    """Slopes and curvatures of the tasks add up to those of all pairs of each cell; every document is in a cell; ranks are exact."""
    rng = np.random.default_rng(3)
    m = np.abs(rng.normal(size=(60, quality.MEASURES))).round(2)
    y = (np.arange(60) % 5 > 0).astype(int)
    rows = spark.createDataFrame([(k, int(y[k]), m[k].tolist()) for k in range(60)], "doc_id long, y int, m array<double>")
    cuts = quality._cut_points(rows)
    assert cuts.shape == (quality.MEASURES, quality.PARTS) and (np.diff(cuts, axis=1) >= 0).all()
    ranker = quality.Ranker(cuts, rng.normal(0, 0.1, cuts.size), 0.0, 1.0, 0.3)
    cells = quality._pair_cells(rows, 48, 12, side=10)
    held = [[np.frombuffer(r[c]).reshape(-1, quality.MEASURES) for c in ("good", "bad")] for r in cells.collect()]
    for k, kind in enumerate((1, 0)):
        assert {tuple(v) for x in held for v in x[k]} == {tuple(v) for v in m[y == kind]}
    g, h, n = quality._slope(cells, ranker)
    d = np.concatenate([(ranker.features(x)[:, None] - ranker.features(z)[None]).reshape(-1, cuts.size) for x, z in held])
    p = 1 / (1 + np.exp(-(d @ ranker.weights)))
    assert n == len(d) and np.allclose(g, d.T @ (1 - p)) and np.allclose(h, (d * (p * (1 - p))[:, None]).T @ d)
    s = np.concatenate([np.repeat(0.5, 300), rng.normal(size=900)])
    scored = spark.createDataFrame([(float(v),) for v in s], "s double")
    assert [quality._at_rank(scored, k, most=5, bins=7) for k in (0, 500, 650, 1199)] == [np.sort(s)[k] for k in (0, 500, 650, 1199)]


def test_pair_likelihood_is_at_its_top():
    """The ranker's weights are where the penalised likelihood of its preference pairs is highest."""
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["good", "word", "Here", "5", "##", "line\n"], int(rng.integers(3, 40)))) for _ in range(120)]
    y = np.array([int(t.count("#") < 3 and rng.random() < 0.8) for t in texts])
    ranker = quality.train_ranker(texts, y, pairs=800, seed=11)
    x = ranker.features(np.array([quality.measure(t) for t in texts], float))
    draw = np.random.default_rng(11)
    d = x[draw.choice(np.flatnonzero(y == 1), 800)] - x[draw.choice(np.flatnonzero(y == 0), 800)]

    def likelihood(w):
        return -sum(np.log1p(np.exp(-float(row @ w))) for row in d) - 0.5 * float(w @ w)

    top = likelihood(ranker.weights)
    for _ in range(20):
        assert likelihood(ranker.weights + rng.normal(0, 0.02, len(ranker.weights))) < top
    s = np.sort(x @ ranker.weights)
    k = int(round((y == 0).sum()))
    assert ranker.limit == pytest.approx((s[k - 1] + s[k]) / 2)
    assert ranker.scores(np.array([quality.measure(t) for t in texts], float)) == pytest.approx(1 / (1 + np.exp(-np.clip(ranker.scale * (x @ ranker.weights - ranker.limit) + np.log(0.3 / 0.7), -40, 40))))


def test_jobs_leave_only_what_their_result_reads(spark):
    """Of the tables a near-duplicate search writes two stay, and none once the scope around has ended."""
    from pathlib import Path

    from mediarill.llm import near_dups
    from mediarill.plans import shared

    docs = spark.createDataFrame([(k, " ".join(f"w{x}" for x in range(k // 2 * 100, k // 2 * 100 + 50))) for k in range(8)], "doc_id long, text string")
    root = Path(shared.shared_dir(spark).removeprefix("file:"))
    tables = lambda: {p for p in root.glob("mediarill-*/*") if any(p.rglob("*.parquet"))}
    before = tables()
    with shared.scratch():
        got = near_dups.near_duplicates(docs)
        assert len(tables() - before) == 2
        assert sorted(r["component_id"] for r in got.collect()) == [0, 0, 2, 2, 4, 4, 6, 6]
    assert tables() == before


@pytest.mark.parametrize(("page", "want"), [
    ("<p>Let <math><mi>x</mi><mo>=</mo><msup><mn>2</mn><mi>n</mi></msup></math> be one.</p>", ["Let x=2n be one."]),
    ("<div><figure><svg viewBox='0 0 9 9'><g><text>North</text><path d='M0'/></g></svg><figcaption>A map</figcaption></figure></div>", ["North", "A map"]),
    ("<p>before <video src=x><track kind=captions>no player here</video> after</p><noscript>read without scripts</noscript>", ["before no player here after", "read without scripts"]),
    ("<p>a <object data=x><iframe>inner</iframe></object><canvas>drawn</canvas> b</p><script>var x = '<p>no</p>'</script><style>p{}</style><template><p>no</p></template>", ["a innerdrawn b"]),
])
def test_formulas_drawings_and_fallbacks_are_read(page, want):
    """Only scripts, styles and templates go unread; the labeller judges the rest."""
    assert [b.text for b in main_text.blocks_of(page)] == want


def test_names_far_up_and_many_names_count():
    deep = "<div class='sidebar'>" + "<div>" * 30 + "<p>x y</p>" + "</div>" * 31
    plain = "<div class='other'>" + "<div>" * 30 + "<p>x y</p>" + "</div>" * 31
    many = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    vectors = [main_text.vectors_of(main_text.blocks_of(p)) for p in (deep, plain, f"<p class='{many}'>x y</p>", f"<p class='{many} last'>x y</p>")]
    assert (vectors[0][:, : main_text.PATH] != vectors[1][:, : main_text.PATH]).any()
    assert (vectors[2][:, : main_text.PATH] != vectors[3][:, : main_text.PATH]).any()


def test_boundaries_of_ten_million_documents():
    """A shard's boundaries and ids are encoded in runs: beside the numbers themselves only their code is held."""
    import tracemalloc

    class Sink:
        size = 0

        def write(self, raw):
            self.size += len(raw)

        def close(self):
            pass

    def peak(n):
        tracemalloc.start()
        writer = token_files.ShardWriter(Sink(), "<u2")
        for a in range(0, n, 100_000):
            writer.add(list(range(3 * a, 3 * (a + 100_000), 3)), np.full(100_000, 50), np.zeros(1, np.uint16))
            writer.n_ids += 50 * 100_000 - 1
        writer.close()
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top / 1e6

    one, ten = peak(1_000_000), peak(10_000_000)
    assert ten < 400 and ten < 11 * one
