"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the document tree.

A page becomes its sequence of leaf blocks (runs of text between block-level tags). Each block has binary features: the
tags and the class and id words of its ancestors, and the shape of its text. The field scores a block as main text or
not, together with its neighbours; Viterbi's algorithm gives the best labelling of the page.

Training pages are a bounded sample of the table's own rows. Their labels come from their markup, where a page says
what is its article and what is menu, footer, advert and so on. The field must also read pages that say less, so each
training page is seen again with its sections renamed to plain classes, with foreign sections put around and into the
article, and with no names at all.
"""

from __future__ import annotations

import html
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.text import chunks, mix

#: Pages the field is trained on, at most: those with the smallest hashes of their id.
TRAIN_PAGES = 200
ROUNDS = 250
PENALTY = 5e-5

#: A quote opens a value right after an equals sign and nowhere else; one that never ends is a character like others.
_ATTRIBUTES = r"(?>=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)?|[^>=]+)*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s>/]*)({_ATTRIBUTES})>|<[!?][^>]*>|</?[a-zA-Z][^>]*\Z|([^<]+|<)", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Text inside these is no text of the page, and only their own end tag is markup.
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I | re.A) for t in "script style noscript textarea iframe".split()}
_SECTIONS = frozenset("article main section header footer nav aside form body h1 h2 h3 h4 h5 h6".split())
_BLOCKS = _SECTIONS | frozenset("address blockquote details div dl figure hr ol p pre table ul".split())
#: Text inside these is none either. They end with their end tag, with one of an element around them, or where a start
#: tag of these names shows that their own end was forgotten.
HIDDEN = {
    "option": _BLOCKS | {"option", "optgroup"}, "select": _BLOCKS - {"hr"} | {"select"}, "button": _SECTIONS | {"button"}, "object": _SECTIONS,
    "canvas": _SECTIONS, "svg": _BLOCKS, "template": frozenset(), "foreignobject": frozenset(),
}
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strong strike sub sup time tt u var wbr".split())
#: A start tag of the key closes open tags of these names, up to the nearest container.
CLOSES = {
    **{t: ("p",) for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()},
    "li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "tr": ("p", "td", "th", "tr"), "td": ("p", "td", "th"), "th": ("p", "td", "th"),
    "body": ("head",),
}
CONTAINERS = frozenset("article aside blockquote body div dl fieldset footer form header main nav ol section table ul".split())

TAGS = "html head title body main article section div p span h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th thead tbody blockquote pre code figure figcaption nav header footer aside form fieldset label a em strong b i address details summary dialog".split()
#: Words of class and id names that speak for a kind of section.
KINDS = {
    "content": "article content main post entry story body text page prose markdown copy narrative lead",
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs toc tabs pagination pager skip links",
    "header": "header head masthead banner topbar top logo brand hero",
    "footer": "footer foot bottom copyright legal colophon imprint",
    "side": "sidebar side aside rail widget related recommended trending popular more teaser tags",
    "notice": "notice cookie cookies consent gdpr alert warning popup modal overlay toast disclaimer message",
    "advert": "ad ads advert advertisement adverts sponsor sponsored promo promotion banner adsense dfp",
    "form": "form search login signup subscribe newsletter register contact poll survey",
    "comment": "comment comments reply replies discussion disqus respond thread reviews feedback",
    "social": "share social follow like facebook twitter author meta byline",
}
_KIND_OF = {}
for _kind, _list in KINDS.items():
    for _name in _list.split():
        _KIND_OF.setdefault(_name, []).append(_kind)

#: Kinds that tags speak for.
TAG_KINDS = {
    "article": "content", "main": "content", "nav": "menu", "header": "header", "footer": "footer", "aside": "side", "form": "form",
    "dialog": "notice", "head": "header",
}
_SIZES = (1, 2, 4, 8, 16, 32, 64, 128)
FEATURES = {
    name: k for k, name in enumerate([
        "bias", *(f"in:{t}" for t in TAGS), *(f"at:{t}" for t in TAGS), *(f"name:{k}" for k in KINDS), *(f"near:{k}" for k in KINDS),
        *(f"words:{n}" for n in _SIZES), *(f"links:{n}" for n in range(4)), *(f"commas:{n}" for n in range(3)),
        "stop", "copyright", "separators", "capitals", "digits", "first", "last", "early", "late",
    ])
}


class _Page:
    """The leaf blocks of a page: text, features and the path of (tag, attributes) above each."""

    def __init__(self, source: str, keep_paths: bool = False):
        self.texts, self.features, self.paths = [], [], []
        self.open: list[tuple[str, tuple, str, str]] = []
        self.run, self.linked, self.size = [], 0, 0
        self.silent, self.in_link, self.keep_paths = 0, 0, keep_paths
        at = 0
        while found := _TOKEN.match(source, at):
            at, text = found.end(), found[4]
            if text is not None:
                if not self.silent:
                    self.run.append(text)
                    self.size += len(text)
                    self.linked += len(text) if self.in_link else 0
            elif found[2]:
                tag = found[2].lower()
                if tag in RAW_END:
                    if not found[1] and not found[3].endswith("/"):
                        ended = RAW_END[tag].search(source, at)
                        at = ended.start() if ended else len(source)
                elif found[1]:
                    self.end(tag)
                else:
                    self.start(tag, found[3])
        self.flush()
        self.place()

    def cut(self, depth):
        del self.open[depth:]
        if self.silent:
            self.silent = sum(o[0] in HIDDEN for o in self.open)

    def start(self, tag, attributes):
        while self.silent:
            depth = next(k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] in HIDDEN)
            if tag not in HIDDEN[self.open[depth][0]]:
                break
            self.cut(depth)
        if tag == "br" and not self.silent:
            self.run.append(" ")
        if tag not in INLINE and tag not in HIDDEN and not self.silent:
            self.flush()
            closes = CLOSES.get(tag, ())
            for depth in range(len(self.open) - 1, -1, -1):
                name = self.open[depth][0]
                if name in closes:
                    self.cut(depth)
                elif name in CONTAINERS:
                    break
        if tag in VOID or attributes.endswith("/") and tag not in TAGS:
            return
        self.in_link += tag == "a"
        above = self.open[-1][1] if self.open else ()
        own = [f"in:{tag}"] if f"in:{tag}" in FEATURES else []
        near, kinds = self.open[-1][3] if self.open else "", [TAG_KINDS[tag]] if tag in TAG_KINDS else []
        if attributes:
            for names in _NAMES.findall(attributes):
                for word in _WORD.findall("".join(names).lower()):
                    kinds += _KIND_OF.get(word, ())
            own += [f"name:{k}" for k in kinds]
        if kinds:  # the nearest section says most; one called content and something else is the latter
            near = next((k for k in kinds if k != "content"), "content")
        new = tuple(FEATURES[n] for n in dict.fromkeys(own) if FEATURES[n] not in above)
        self.open.append((tag, above + new if new else above, attributes, near))
        self.silent += tag in HIDDEN

    def end(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                hidden = any(o[0] in HIDDEN for o in self.open[:depth + 1]) if self.silent else False
                if tag in INLINE:
                    self.in_link -= tag == "a"
                elif not hidden:
                    self.flush()
                self.cut(depth)
                return
            if tag in INLINE and self.open[depth][0] not in INLINE:
                return

    def flush(self):
        self.in_link = sum(o[0] == "a" for o in self.open) if self.in_link else 0
        if self.run:
            text = " ".join(html.unescape("".join(self.run)).split())
            if text:
                above = self.open[-1][1] if self.open else ()
                block = next((o[0] for o in reversed(self.open) if o[0] not in INLINE), "html")
                self.texts.append(text)
                near = (FEATURES[f"near:{self.open[-1][3]}"],) if self.open and self.open[-1][3] else ()
                self.features.append((*above, *near, *self.shape(text, block)))
                if self.keep_paths:
                    self.paths.append([(o[0], o[2]) for o in self.open])
            self.run, self.linked, self.size = [], 0, 0

    def shape(self, text, block):
        n = text.count(" ") + 1
        yield FEATURES["bias"]
        if f"at:{block}" in FEATURES:
            yield FEATURES[f"at:{block}"]
        for size in _SIZES:
            if n >= size:
                yield FEATURES[f"words:{size}"]
        yield FEATURES[f"links:{min(3, 3 * self.linked // max(1, self.size))}"]
        yield FEATURES[f"commas:{min(2, text.count(','))}"]
        if text[-1] in ".!?…\"'”»:":
            yield FEATURES["stop"]
        if "©" in text or "(c)" in text[:80].lower():
            yield FEATURES["copyright"]
        if "·" in text or "|" in text or "»" in text[:-1]:
            yield FEATURES["separators"]
        if n > 1 and text.istitle() or text.isupper():
            yield FEATURES["capitals"]
        if sum(map(str.isdigit, text[:200])) * 4 > min(len(text), 200):
            yield FEATURES["digits"]

    def place(self):
        n = len(self.features)
        for k in range(n):
            more = [FEATURES[name] for name, holds in (("first", k == 0), ("last", k == n - 1), ("early", 8 * k < n), ("late", 8 * (k + 1) > 7 * n)) if holds]
            if more:
                self.features[k] = (*self.features[k], *more)


_OUTSIDE = re.compile(
    r"\b(?:nav|menu|breadcrumbs?|header|masthead|footer|sidebar|related|widget|notice|cookies?|consent|popup|modal|alert|ads?|adverts?|advertisement|sponsor(?:ed)?|promo|"
    r"newsletter|subscribe|login|search|comments?|replies|disqus|respond|share|social)\b"
)


def marked_main(path) -> bool:
    """What a page's markup says of a block: inside an article or main part, and in nothing foreign there."""
    inside = False
    for tag, attributes in path:
        names = " ".join("".join(n) for n in _NAMES.findall(attributes)).lower()
        if tag in ("article", "main") or re.search(r"\bmain\b", names) and tag in ("div", "section", "td"):
            inside = True
        elif tag in ("nav", "aside", "footer", "form", "head", "header", "dialog") or _OUTSIDE.search(names.replace("_", " ").replace("-", " ")):
            return False
    return inside


#: What sections are called on pages without telling tags: (kind of section, tag, attributes).
_CALLED = {
    "article": [("div", ' class="content"'), ("div", ' class="post"'), ("section", ' id="main"'), ("div", ' class="entry-content"'), ("main", ""), ("div", ' class="article-body"'), ("div", "")],
    "nav": [("div", ' class="menu"'), ("div", ' id="navbar"'), ("ul", ' class="breadcrumb"'), ("div", "")],
    "footer": [("div", ' class="footer"'), ("div", ' id="bottom"'), ("div", "")],
    "ad": [("div", ' class="advert"'), ("aside", ' class="sponsored"'), ("div", ' id="promo"'), ("section", ' class="ads"')],
}
#: Sections that pages put around and into their article: (tag, attributes, tag of each block).
_FOREIGN = [
    ("header", "", "div"), ("div", ' class="header"', "h1"), ("aside", "", "p"), ("div", ' class="sidebar"', "p"), ("div", ' class="cookie-notice"', "p"),
    ("div", ' class="notice"', "div"), ("form", ' class="newsletter"', "label"), ("form", "", "p"), ("div", ' class="related"', "li"),
    ("section", ' class="comments"', "p"), ("div", ' id="comments"', "p"), ("div", ' class="comment"', "div"), ("ol", ' class="replies"', "li"),
    ("div", ' class="ad"', "p"), ("div", ' class="share"', "a"), ("div", ' class="consent-banner"', "p"), ("div", ' class="widget"', "p"), ("nav", "", "a"),
]


def _variants(source: str, number: int, foreign: list[str]):
    """The page as it is, and seen otherwise; the main text keeps a mark that the labels are read from."""
    pick = lambda choices, k: choices[int(mix(np.array([number * 31 + k], np.uint64))[0] % np.uint64(len(choices)))]
    yield source
    def section(k):
        tag, attributes, block = pick(_FOREIGN, k)
        some = "".join(f"<{block}>{html.escape(pick(foreign, 100 * k + j))}</{block}>" for j in range(1 + k % 3))
        return f"<{tag}{attributes}>{some}</{tag}>"

    if foreign:
        around = re.sub(r"(<article\b)", lambda m: section(1) + section(2) + m[1], source, count=1, flags=re.I)
        around = re.sub(r"(</article\s*>)", lambda m: section(3) + m[1] + section(4) + section(5), around, count=1, flags=re.I)
        ends = iter(range(10, 10_000))  # one foreign section behind every third paragraph or so
        around = re.sub(r"</p\s*>(?=<p>)", lambda m: m[0] + (section(k) if pick((0, 0, 1), k := next(ends)) else ""), around, flags=re.I)
        yield around
    else:
        around = source
    for seen in (source, around):
        for kind, calls in _CALLED.items():
            tag, attributes = pick(calls, len(kind))
            if kind == "ad":
                seen = re.sub(r'<div class="ad">(.*?)</div>', lambda m: f"<{tag}{attributes}>{m[1]}</{tag}>", seen, flags=re.S)  # noqa: B023
            else:
                mark = ' data-part="article"' if kind == "article" else ""
                seen = re.sub(rf"<{kind}\b[^>]*>", f"<{tag}{attributes}{mark}>", seen, flags=re.I)
                seen = re.sub(rf"</{kind}\s*>", f"</{tag}>", seen, flags=re.I)
        head, block = pick(("h1", "h2", "h3"), 7), pick(("p", "p", "div"), 8)
        seen = re.sub(r"(</?)h1>", rf"\1{head}>", seen, flags=re.I)
        seen = re.sub(r"<p>([^<]*)</p>", rf"<{block}>\1</{block}>", seen, flags=re.I)
        yield seen


def _label(path) -> bool:
    named = any("data-part=" in attributes for _, attributes in path)
    return marked_main([("article", "") if "data-part=" in a else (t, a) for t, a in path]) if named else marked_main(path)


def _examples(pages: DataFrame) -> DataFrame:
    """(features, labels): the labelled blocks of every training page and of its variants."""

    def run(batches):
        before: list[str] = []
        for batch in chunks(batches, "html"):
            features, labels = [], []
            for number, source in enumerate(batch.column("html").to_pylist()):
                texts = _Page(source or "").texts
                for variant in _variants(source or "", number, before or texts):
                    page = _Page(variant, keep_paths=True)
                    if page.texts:
                        features.append([list(f) for f in page.features])
                        labels.append([int(_label(p)) for p in page.paths])
                before = [t for t in texts if len(t) < 400][-40:] or before
            yield pa.RecordBatch.from_arrays(
                [pa.array(features, pa.list_(pa.list_(pa.int32()))), pa.array(labels, pa.list_(pa.int32()))], ["features", "labels"]
            )

    return pages.mapInArrow(run, "features array<array<int>>, labels array<int>")


class Field:
    """Weights of the features for main text, of transitions (from, to), of beginnings and of ends."""

    def __init__(self, weights, step, begin, end):
        self.weights, self.step, self.begin, self.end = weights, step, begin, end

    def decode(self, features) -> list[bool]:
        """Viterbi's best labelling; a tie goes to not main."""
        if not features:
            return []
        flat = np.fromiter(chain.from_iterable(features), np.int64)
        sizes = np.fromiter(map(len, features), np.int64, len(features))
        gain = np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes).tolist()
        (nn, nm), (mn, mm) = self.step.tolist()
        not_main, main, back = self.begin[0], self.begin[1] + gain[0], []
        for g in gain[1:]:
            from_main = (main + mn > not_main + nn, main + mm > not_main + nm)
            back.append(from_main)
            not_main, main = (main + mn if from_main[0] else not_main + nn), (main + mm if from_main[1] else not_main + nm) + g
        state = main + self.end[1] > not_main + self.end[0]
        labels = [bool(state)]
        for from_main in reversed(back):
            state = from_main[1 if state else 0]
            labels.append(bool(state))
        return labels[::-1]


def _expectations(gain, mask, labels, step, begin, end):
    """Log likelihood's gradient by forward and backward sums, for padded pages (page, block)."""
    n, length = gain.shape
    emit = np.stack([np.zeros_like(gain), gain], axis=2)
    forward = np.empty((n, length, 2))
    forward[:, 0] = begin + emit[:, 0]
    for t in range(1, length):
        new = np.logaddexp(forward[:, t - 1, 0, None] + step[0], forward[:, t - 1, 1, None] + step[1]) + emit[:, t]
        forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
    total = np.logaddexp(forward[:, -1, 0] + end[0], forward[:, -1, 1] + end[1])
    backward = np.empty((n, length, 2))
    backward[:, -1] = end
    for t in range(length - 2, -1, -1):
        ahead = backward[:, t + 1] + emit[:, t + 1]
        new = np.logaddexp(ahead[:, 0, None] + step[:, 0], ahead[:, 1, None] + step[:, 1])
        backward[:, t] = np.where(mask[:, t + 1, None], new, backward[:, t + 1])
    single = np.exp(forward + backward - total[:, None, None])
    both = np.exp(
        forward[:, :-1, :, None] + step + (backward + emit)[:, 1:, None, :] - total[:, None, None, None]
    ) * mask[:, 1:, None, None]
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[:, :-1][mask[:, 1:]], labels[:, 1:][mask[:, 1:]]), 1)
    last = mask.sum(axis=1) - 1
    rows = np.arange(n)
    return (
        np.where(mask, labels - single[:, :, 1], 0.0), seen - both.sum(axis=(0, 1)),
        np.bincount(labels[:, 0], minlength=2) - single[:, 0].sum(axis=0),
        np.bincount(labels[rows, last], minlength=2) - single[rows, last].sum(axis=0),
    )


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", train_pages: int = TRAIN_PAGES) -> Field:
    """The field that fits at most ``train_pages`` pages best, by gradient steps of adaptive size.

    A repeated id gives one of its pages. Without a page, weights are zero and nothing is main text.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).where("id IS NOT NULL AND html IS NOT NULL")
    ids = rows.select("id").orderBy(F.xxhash64("id"), "id").limit(train_pages).distinct()
    chosen = rows.join(F.broadcast(ids), "id").groupBy("id").agg(F.min_by("html", F.xxhash64("html")).alias("html"))
    found = sorted((r["labels"], r["features"]) for r in _examples(chosen.orderBy("id").coalesce(1).select("html")).collect())
    width = len(FEATURES)
    if not found:
        return Field(np.zeros(width), np.zeros((2, 2)), np.zeros(2), np.zeros(2))
    length = max(len(labels) for labels, _ in found)
    mask = np.zeros((len(found), length), bool)
    labels = np.zeros((len(found), length), np.int64)
    for k, (truth, _) in enumerate(found):
        mask[k, :len(truth)] = True
        labels[k, :len(truth)] = truth
    flat = np.fromiter(chain.from_iterable(chain.from_iterable(f for _, f in found)), np.int64)
    sizes = np.array([len(b) for _, f in found for b in f])
    block = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    n, parts = len(sizes), np.zeros(width + 8)
    mean, square = np.zeros_like(parts), np.zeros_like(parts)
    for k in range(1, ROUNDS + 1):
        gain = np.zeros(mask.shape)
        gain[mask] = np.add.reduceat(parts[:width][flat], first)
        step, begin, end = parts[width:width + 4].reshape(2, 2), parts[width + 4:width + 6], parts[width + 6:]
        on_block, on_step, on_begin, on_end = _expectations(gain, mask, labels, step, begin, end)
        slope = np.concatenate([np.bincount(flat, on_block[mask][block], width), on_step.ravel(), on_begin, on_end]) / n - PENALTY * parts
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        parts = parts + 0.15 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    return Field(parts[:width], parts[width:width + 4].reshape(2, 2), parts[width + 4:width + 6], parts[width + 6:])


def extract_main_text(pages: DataFrame, field: Field, html_col: str = "html", out: str = "main_text") -> DataFrame:
    """All rows and columns of ``pages`` with a text column ``out``: the main blocks in page order, two line ends between.

    Character references are decoded, white space inside a block is one blank. A null or empty page, and one without
    main blocks, gives an empty text. A column already named ``out`` is replaced; repeated rows are read each; an empty
    table stays empty. Pages are read whole.
    """
    from pyspark.sql import types as T

    pages = pages.drop(out)

    def run(batches):
        for batch in chunks(batches, html_col):
            texts = []
            for source in batch.column(html_col).to_pylist():
                page = _Page(source or "")
                main = field.decode(page.features)
                texts.append("\n\n".join(t for t, m in zip(page.texts, main) if m))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField(out, T.StringType())]))
