"""Main text of web pages: a linear-chain conditional random field labels the leaf blocks of the DOM."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Tags that do not end a block, tags without content, tags whose content is no text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg".split())
#: Tags that an opening tag of the group closes, up to the given borders.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
BORDERS = frozenset("article aside blockquote body button caption div fieldset footer form header html main nav section table td th".split())
TRAINING_PAGES = 400


@dataclass(slots=True)
class Block:
    """Text of a leaf block, its ancestors (tag, class and id words; outermost first) and how much of it is links."""

    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]
    linked: int


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.silent = 0
        self.links = 0
        self.found: list[Block] = []

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                path = tuple(x for x in self.stack if x[0] not in INLINE)
                self.found.append(Block(text, path, self.linked))
            self.parts, self.linked = [], 0

    def _drop(self, at: int) -> None:
        self.flush()
        for tag, _ in self.stack[at:]:
            self.links -= tag == "a"
        del self.stack[at:]

    def _close_until(self, tags: set[str], borders) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[i][0]
            if tag in tags:
                self._drop(i)
                return
            if tag in borders:
                return

    def handle_starttag(self, tag, attrs) -> None:
        if tag in SILENT:
            self.silent += 1
            return
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            if tag not in INLINE:
                self.flush()
            return
        if tag not in INLINE:
            self.flush()
            self._close_until({"p"}, BORDERS)
            if tag in CLOSES:
                self._close_until(*CLOSES[tag])
        names = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        words = tuple(dict.fromkeys(re.findall(r"[a-z]+", names.lower()))) if names else ()
        self.stack.append((tag, words))
        self.links += tag == "a"

    def handle_endtag(self, tag) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if tag in INLINE:
                    self.links -= tag == "a"
                    del self.stack[i]
                else:
                    self._drop(i)
                return
            if tag in INLINE and self.stack[i][0] in BORDERS:
                return

    def handle_data(self, data) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.links > 0:
                self.linked += len(data)


def blocks(html: str) -> list[Block]:
    """Leaf blocks in page order, character references decoded, white space inside a block made one space."""
    if "<![" in html:
        html = re.sub(r"<!\[[^>]*>?", "", html)
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.found


_ENDS = frozenset(".!?:;…。\"'”»)")


def features(page: list[Block]) -> list[list[str]]:
    """Names of the binary features of every block."""
    out = []
    for i, b in enumerate(page):
        names = ["bias"]
        for tag, words in b.path:
            if tag not in ("html", "body"):
                names.append("in " + tag)
            names += ["name " + w for w in words]
        names.append("tag " + (b.path[-1][0] if b.path else "none"))
        size = len(b.text)
        names.append(f"size {min(size.bit_length(), 9)}")
        names.append(f"linked {min(4, 4 * b.linked // max(size, 1))}")
        if b.text[-1] in _ENDS:
            names.append("ends")
        if b.text[0] == "©" or "copyright" in b.text[:40].lower():
            names.append("copyright")
        if size < 400 and sum(c.isdigit() for c in b.text) * 4 > size:
            names.append("digits")
        if i == 0:
            names.append("first")
        if i == len(page) - 1:
            names.append("last")
        if i and page[i - 1].path[:-1] == b.path[:-1]:
            names.append("sibling")
        out.append(list(dict.fromkeys(names)))
    return out


@dataclass
class Field:
    """Weights of a linear-chain conditional random field with labels other (0) and main text (1)."""

    weights: dict[str, tuple[float, float]]
    steps: list[list[float]]

    def decode(self, page: list[list[str]]) -> list[int]:
        """The most probable labels, by Viterbi."""
        back, best = [], [0.0, 0.0]
        for t, names in enumerate(page):
            own = [0.0, 0.0]
            for name in names:
                w = self.weights.get(name)
                if w:
                    own[0] += w[0]
                    own[1] += w[1]
            if not t:
                best = own
                continue
            row, new = [], []
            for y in (0, 1):
                a, b = best[0] + self.steps[0][y], best[1] + self.steps[1][y]
                row.append(int(b > a))
                new.append(max(a, b) + own[y])
            back.append(row)
            best = new
        label = int(best[1] > best[0])
        labels = [label]
        for row in reversed(back):
            label = row[label]
            labels.append(label)
        return labels[::-1] if page else []


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 200, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by forward-backward and Adam over all pages at once."""
    names = sorted({n for page, _ in pages for block in page for n in block})
    number = {n: i for i, n in enumerate(names)}
    longest = max(len(p) for p, _ in pages)
    x = np.zeros((len(pages), longest, len(names)), np.float32)
    gold, mask = np.zeros((len(pages), longest), int), np.zeros((len(pages), longest), bool)
    for i, (page, labels) in enumerate(pages):
        gold[i, : len(labels)], mask[i, : len(labels)] = labels, True
        for t, block in enumerate(page):
            x[i, t, [number[n] for n in block]] = 1
    flat = x.reshape(-1, len(names))
    hot = np.eye(2)[gold] * mask[..., None]
    both = mask[:, 1:] & mask[:, :-1]
    pairs = np.einsum("ita,itb,it->ab", hot[:, :-1], hot[:, 1:], both.astype(float))
    params = [np.zeros((len(names), 2)), np.zeros((2, 2))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        w, a = params
        own = (flat @ w).reshape(len(pages), longest, 2)
        forward, backward = np.zeros_like(own), np.zeros_like(own)
        forward[:, 0] = own[:, 0]
        for t in range(1, longest):
            new = np.logaddexp.reduce(forward[:, t - 1, :, None] + a, axis=1) + own[:, t]
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(a[None] + (own[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(mask[:, t + 1, None], new, 0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        unary = np.exp(forward + backward - total[:, None, None]) * mask[..., None]
        joint = forward[:, :-1, :, None] + a + (own + backward)[:, 1:, None, :] - total[:, None, None, None]
        joint = np.exp(np.minimum(joint, 0)) * both[..., None, None]
        n = len(pages)
        grads = [flat.T @ (unary - hot).reshape(-1, 2) / n + ridge * w, (joint.sum((0, 1)) - pairs) / n + ridge * a]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            params[k] = params[k] - 0.1 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    w, a = params
    return Field({n: (float(w[i, 0]), float(w[i, 1])) for n, i in number.items()}, a.tolist())


def labelled_page(rng: random.Random) -> tuple[str, list[int]]:
    """A page made by rule, and for each of its leaf blocks whether it is main text."""
    out: list[str] = []
    labels: list[int] = []
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(60)]

    def phrase(low: int, high: int, end: str = "") -> str:
        return " ".join(rng.choice(words) for _ in range(rng.randint(low, high))).capitalize() + end

    def put(label: int, html: str, n: int = 1) -> None:
        out.append(html)
        labels.extend([label] * n)

    def named(tag: str, names: list[str]) -> str:
        return f'<{tag} {rng.choice(("class", "id"))}="{rng.choice(names)}">'

    def menu(wrap: bool = True) -> None:
        tag = "nav" if rng.random() < 0.6 else "div"
        out.append("<nav>" if tag == "nav" and rng.random() < 0.5 else named(tag, ["menu", "navbar", "main-nav", "breadcrumb", "toolbar"]))
        out.append("<ul>")
        for _ in range(rng.randint(2, 7)):
            put(0, f'<li><a href="/x">{phrase(1, 3)}</a></li>')
        out.append(f"</ul></{tag}>")

    def junk(names: list[str], tags: tuple[str, ...] = ("div", "aside", "section")) -> None:
        tag = rng.choice(tags)
        out.append(f"<{tag}>" if tag not in ("div", "section") and rng.random() < 0.4 else named(tag, names))
        for _ in range(rng.randint(1, 3)):
            kind = rng.random()
            if kind < 0.3:
                put(0, phrase(2, 12, rng.choice(("", "."))) + "<br>" if not out[-1].endswith("<br>") else f"<p>{phrase(2, 9)}</p>")
                out.append("<p></p>")
            elif kind < 0.7:
                put(0, f"<p>{phrase(3, 40, '.')}</p>")
            else:
                put(0, f'<p><a href="#">{phrase(1, 6)}</a></p>')
        out.append(f"</{tag}>")

    def form() -> None:
        out.append("<form>" if rng.random() < 0.6 else "<form class='search'>")
        put(0, f"<label>{phrase(1, 3)}</label><input name=q>")
        if rng.random() < 0.6:
            put(0, f"<button>{phrase(1, 2)}</button>")
        out.append("</form>")

    def comments() -> None:
        out.append(named(rng.choice(("div", "section")), ["comments", "comment-list", "discussion", "replies", "reader-comments"]))
        if rng.random() < 0.5:
            put(0, f"<h3>{phrase(1, 3)}</h3>")
        for _ in range(rng.randint(1, 4)):
            out.append('<div class="comment">')
            put(0, f"<p>{phrase(4, 60, '.')}</p>")
            out.append("</div>")
        out.append("</div>" if out[-1] == "</div>" else "")
        out.append("</section>")

    out.append("<!DOCTYPE html><html><head><meta charset='utf-8'>")
    put(0, f"<title>{phrase(2, 9)}</title>")
    out.append("<style>p{margin:0}</style><script>var t='</p>';</script></head><body>")
    if rng.random() < 0.3:
        junk(["cookie-notice", "consent", "notice", "banner", "alert", "popup"], ("div",))
    if rng.random() < 0.5:
        out.append("<header>" if rng.random() < 0.6 else named("div", ["header", "masthead", "topbar", "site-header"]))
        put(0, f"<{(h := rng.choice(('h1', 'p', 'div')))}>{phrase(1, 6)}</{h}>")
        out.append("</header></div>")
    if rng.random() < 0.9:
        menu()
    if rng.random() < 0.3:
        form()
    if rng.random() < 0.5:
        junk(["ad", "ads", "advert", "sponsored", "promo", "banner"], ("div",))
    if rng.random() < 0.3:
        junk(["sidebar", "side", "widget", "related"])
    kind = rng.random()
    outer = "article" if kind < 0.6 else "main" if kind < 0.75 else "div"
    out.append(f"<{outer}>" if outer != "div" and rng.random() < 0.7 else named(outer, ["content", "article", "post", "entry", "story", "main"]))
    if rng.random() < 0.85:
        put(1, f"<{(h := rng.choice(('h1', 'h1', 'h2')))}>{phrase(2, 10)}</{h}>")
    for _ in range(rng.randint(1, 12)):
        kind = rng.random()
        if kind < 0.6:
            put(1, f"<p>{phrase(1, 90, rng.choice(('.', '.', '.', '', '?')))}</p>")
        elif kind < 0.72:
            put(1, f"<p><b>{phrase(1, 12, '.')}<br>")
        elif kind < 0.78:
            put(1, f"<h2>{phrase(1, 6)}</h2>")
        elif kind < 0.84:
            out.append("<ul>")
            for _ in range(rng.randint(2, 4)):
                put(1, f"<li>{phrase(1, 15, rng.choice(('', '.')))}</li>")
            out.append("</ul>")
        elif kind < 0.88:
            put(1, f"<blockquote><p>{phrase(5, 30, '.')}</p></blockquote>")
        elif kind < 0.91:
            put(1, f"<p>{phrase(3, 20)} <a href='/y'>{phrase(1, 4)}</a> {phrase(3, 20, '.')}</p>")
        elif kind < 0.94:
            out.append("<table><tr>")
            for _ in range(rng.randint(2, 4)):
                put(1, f"<td>{phrase(1, 3)}</td>")
            out.append("</tr></table>")
        elif kind < 0.96:
            put(1, f"<pre>{phrase(3, 30)}</pre>")
        elif kind < 0.98:
            junk(["ad", "promo", "related", "newsletter"], ("div", "aside"))
        else:
            put(1, f"<div>{phrase(5, 50, '.')}</div>")
    if rng.random() < 0.1:
        comments()
    out.append(f"</{outer}>")
    if rng.random() < 0.35:
        comments()
    if rng.random() < 0.3:
        junk(["sidebar", "related", "share", "newsletter", "widget"])
    if rng.random() < 0.9:
        out.append("<footer>" if rng.random() < 0.8 else named("div", ["footer", "bottom", "legal"]))
        put(0, f"&copy; {phrase(1, 3)}.example &middot; {phrase(1, 25, '.')}")
        if rng.random() < 0.3:
            put(0, f"<p>{phrase(1, 12)}</p>")
        out.append("</footer></div>")
    if rng.random() < 0.8:
        out.append("</body></html>")
    return "".join(out), labels


def training_set(n: int = TRAINING_PAGES, seed: int = 1) -> list[tuple[list[list[str]], list[int]]]:
    """``n`` labelled pages as features and labels; pages whose labels and blocks do not pair up are left out."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        html, labels = labelled_page(rng)
        page = blocks(html)
        if len(page) == len(labels):
            out.append((features(page), labels))
    return out


def main_text(html: str | None, field: Field) -> str:
    page = blocks(html or "")
    return "\n".join(b.text for b, y in zip(page, field.decode(features(page)), strict=True) if y)


def extract(pages: DataFrame, field: Field, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``text`` (main blocks joined by line ends) and ``n_chars`` (its code points).

    The whole ``html`` is read; null, empty and unparsable pages have an empty text. Rows are independent, so repeated rows and
    null keys are treated like any other. Columns of ``keep`` named text or n_chars are replaced.
    """
    keep = [c for c in keep if c not in ("text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, field) for h in batch.column(len(keep)).to_pylist()]
            own = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *own], names=[*keep, "text", "n_chars"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.select(*keep).schema)
    return pages.select(*keep, "html").mapInArrow(run, schema + "text string, n_chars long")
