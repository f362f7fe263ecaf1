"""Main text of web pages by deduction of templates from equivalence classes (after Arasu & Garcia-Molina 2003).

1. A token is a tag, with its named attributes, at its path of containers (which tells apart its roles), or a piece of text in a container other than the article itself. Its
   occurrence vector is its count on each page of its host. Vectors are known by two sums modulo 2 of 64-bit hashes of (page, count), so they're made
   by partial sums per host and token: a host with a third of all pages meets in no task.
2. Tokens of one host with equal vectors, on at least SUPPORT of its pages, are an equivalence class. Classes with one occurrence a page on SHARE of the pages that have tokens
   make up the root, so foreign and broken pages don't empty a template; texts that come equally often on so many pages belong to it too. Classes that come more often are
   valid if all their tokens lie directly below one container, and are nested there: its records.
3. A page is walked along the template. Template tokens split it into slots, and what is left of a slot's text is data; text of the root class falls away, inside the article
   too if it has a container of its own. Containers whose nested records are links and hold little else than link text are menus. The slots of the main text
   are those below the article or main element; where the template has none, those below the deepest container that holds MAJOR of the host's text.
4. Elements for menus, headers, footers, sidebars, forms and scripts aren't text. Names of roles in class, id and role attributes (comments, adverts, notices and the like, whose
   text differs from page to page, so no template tells them from an article) leave out a container only if it doesn't hold the larger part of the text.

A host with one page has no classes; its page is split by its elements alone. Null html, and pages without text, give an empty text. Null urls share one host.
Repeated rows are extracted each. Unclosed and wrongly nested elements end with the container around them. Extra columns aren't read."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacklight.session import dropped, written

# Names of elements and of roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("html head body header footer nav aside main article section div form ul ol li dl table thead tbody tr td th figure blockquote details dialog fieldset menu select button noscript template iframe svg".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 pre dt dd figcaption address caption br hr title option legend summary".split())
SKIPPED = frozenset("head nav footer aside form menu select button dialog noscript template iframe svg fieldset".split())
ROLES = frozenset("ad ads adbox advert adverts advertisement advertising banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist respond replies disqus discussion form search toolbar pagination pager copyright legal disclaimer skip".split())
MAIN = ("article", "main")
#: A piece of text is the template's if it comes equally often on at least this share of its host's pages, so some foreign or broken pages don't empty the template.
SHARE = 0.8
#: A class is known if it is on at least this share of the pages; a container is the main one if it holds this share of the text.
SUPPORT, MAJOR = 0.5, 0.6

_PART = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|noscript|template|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>|<[!?/][^>]*(?:>|\Z)", re.DOTALL | re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")
#: Tokens of links, and of the elements that hold the main text.
_LINK = re.compile(r"/a(\[.*\])?>$")
_ARTICLE = re.compile(r"/(article|main)(\[.*\])?>$")


def parts(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, value): 'open', 'close' and 'text' in page order. Comments, scripts and styles are left out."""
    at = 0
    for m in _PART.finditer(page):
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at = m.end()
        if m[3]:
            yield ("close" if m[2] else "open"), m[3].lower(), m[4] or ""
        elif m[6]:  # a quote that isn't closed
            yield ("close" if m[5] else "open"), m[6].lower(), m[7] or ""
    if at < len(page):
        yield "text", "", page[at:]


def named(attributes: str) -> tuple[str, frozenset[str]]:
    """Class, id and role as part of a token (digits alike), and their words."""
    if not attributes or "=" not in attributes:
        return "", frozenset()
    found = sorted((k.lower(), a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes))
    return "".join(f"[{k}={_DIGITS.sub('#', v)}]" for k, v in found), frozenset(w for _, v in found for w in _WORD.findall(v.lower()))


@dataclass(frozen=True)
class Text:
    """A piece of text: where it stands, and what its elements say of it."""

    text: str
    path: str  # of containers
    inside: bool  # the article
    flow: bool  # directly in the article, in no container of its own
    skipped: bool  # below an element that isn't text
    roles: tuple[str, ...]  # paths of the containers with a name of a role
    link: bool
    fresh: bool  # a block starts before it

    @property
    def token(self) -> str:
        t = _SPACE.sub(" ", self.text).strip()
        return "#" + hashlib.md5(t.encode("utf-8", "replace")).hexdigest() if t else ""


class Walk:
    """Tokens and texts of a page, each with the containers around it."""

    def __init__(self, page: str):
        self.tokens: list[tuple[str, str]] = []  # (token, container path)
        self.texts: list[Text] = []
        stack: list[tuple[str, str, bool, bool, tuple[str, ...], bool]] = []  # (name, path, skipped, in article, roles, is the article)
        fresh, links = True, 0
        for kind, name, value in parts(page):
            _, path, skipped, inside, roles, main = stack[-1] if stack else ("", "", False, False, (), False)
            if kind == "text":
                self.texts.append(Text(value, path, inside, main, skipped, roles, links > 0, fresh))
                fresh = False
                continue
            fresh = fresh or name in BLOCKS
            if name == "a":
                links = 1 if kind == "open" else 0
            if kind == "open":
                label, words = named(value)
                token = f"{path}/{name}{label}"
                self.tokens.append((f"<{token}>", path))
                if name in CONTAINERS and name not in VOID:
                    links = 0
                    article = name in MAIN or ("main" in value.lower() and "role" in value.lower())
                    skip = not article and (name in SKIPPED or (name == "header" and not inside))
                    odd = not article and bool(words & ROLES)
                    stack.append((name, token, skipped or skip, inside or (article and not skipped), (*roles, token) if odd else roles, article))
            elif name in CONTAINERS:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        self.tokens.append((f"</{stack[i][1]}>", stack[i - 1][1] if i else ""))
                        del stack[i:]
                        break
            else:
                self.tokens.append((f"</{path}/{name}>", path))

    def main_text(self, template: Template) -> str:
        texts = [x for x in self.texts if not x.skipped and not template.drops(x)]
        if any(x.inside and x.text.strip() for x in texts):
            texts = [x for x in texts if x.inside]
        elif template.main and any(below(x.path, template.main) and x.text.strip() for x in texts):
            texts = [x for x in texts if below(x.path, template.main)]
        # where everything is template, the template is all there is
        return joined([x for x in texts if x.flow or x.token not in template.texts]) or joined(texts)


def joined(texts: list[Text]) -> str:
    """Blocks in page order, white space inside a block as one space. A block starts where an element does that is one, also in texts that are left out between."""
    out, block = [], []
    for x in texts:
        if block and x.fresh:
            out.append("".join(block))
            block = []
        block.append(entities.unescape(x.text))
    out.append("".join(block))
    return " ".join(t for x in out if (t := _SPACE.sub(" ", x).strip()))


def below(path: str, container: str) -> bool:
    return path == container or path.startswith(container + "/")


class Template:
    """What a host's classes say of its pages: texts of the root class, containers that are menus, the main container, and which roles hold the text."""

    def __init__(self, root: Iterable[str] = (), texts: Iterable[tuple[str, str, int]] = (), nested: Iterable[tuple[str, list[str]]] = (), masses: Iterable[tuple[str, int, int]] = ()):
        self.texts, self.masses = set(), {p: (chars, links) for p, chars, links in masses}
        for token, place, pages in texts:
            n, size, path = place[1:].split(" ", 2)  # how often on a page, its characters, its container
            self.texts.add(token)
            chars, links = self.masses.get(path, (0, 0))
            self.masses[path] = max(0, chars - pages * int(n) * int(size)), links  # masses are of data
        self.menus = frozenset(c for c, tokens in nested if any(_LINK.search(t) for t in tokens) and self._mass(c, 1) >= max(1, SHARE * self._mass(c)))
        self.total = sum(n for n, _ in self.masses.values())
        self.main = "" if any(_ARTICLE.search(t) for t in root) else self._deepest()
        self._kept: dict[str, bool] = {}

    def _mass(self, container: str, which: int = 0) -> int:
        return sum(m[which] for p, m in self.masses.items() if below(p, container))

    def _deepest(self) -> str:
        """The deepest container that holds the larger part of the text."""
        parents = {p[:i] for p in self.masses for i, c in enumerate(p) if c == "/" and i} | {*self.masses}
        major = [p for p in parents if p and self._mass(p) >= MAJOR * max(1, self.total)]
        return max(major, key=len, default="")

    def drops(self, x: Text) -> bool:
        for role in x.roles:
            if role not in self._kept:
                self._kept[role] = self._mass(role) > 0.5 * max(1, self.total)
            if not self._kept[role]:
                return True
        return any(below(x.path, m) for m in self.menus)


def host_of(url: str = "url") -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


_VECTOR = "host string, token string, path string, pages long, total long, x1 long, x2 long"
_M64 = (1 << 64) - 1


def mixed(x: int) -> int:
    """A bijection of 64-bit values (the finalizer of splitmix64)."""
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & _M64
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & _M64
    return x ^ x >> 31


def counted(page: str) -> dict[tuple[str, str], int]:
    """Numbers of occurrences of a page's tokens, by (token, container). Texts are apart by how often they come; rows of text and link characters by container; '' if there is anything."""
    walk = Walk(page)
    count = Counter(walk.tokens)
    texts: Counter = Counter((t, x.path) for x in walk.texts if not x.skipped and not x.flow and (t := x.token))
    size = {x.token: len(x.text.strip()) for x in walk.texts}
    for (t, path), n in texts.items():
        count[t, f"#{n} {size[t]} {path}"] = n
    for x in walk.texts:
        if not x.skipped and (n := len(x.text.strip())):
            count["=", x.path] += n
            count["@", x.path] += n if x.link else 0
    if count:
        count["", ""] = 1  # a page that has tokens counts as one of its host
    return count


def _vectors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[str, str, str], list[int]] = {}

    def flushed() -> pa.RecordBatch:
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        rows = [(*k, v[0], v[1], signed(v[2]), signed(v[3])) for k, v in sums.items()]
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i < 3 else pa.int64()) for i in range(7)], ["host", "token", "path", "pages", "total", "x1", "x2"])

    for b in it:
        for host, mark, page in zip(b.column("host").to_pylist(), b.column("mark").to_pylist(), b.column("html").to_pylist(), strict=True):
            for (token, path), n in counted(page or "").items():
                have = sums.setdefault((host, token, path), [0, 0, 0, 0])
                have[0] += 1
                have[1] += n
                if token not in ("=", "@", ""):
                    h = mixed((mark & _M64) + n * 0x9E3779B97F4A7C15 & _M64)
                    have[2] ^= h
                    have[3] ^= mixed(h ^ 0x2545F4914F6CDD1D)
        if len(sums) > 100_000:
            yield flushed()
    if sums:
        yield flushed()


def templates(pages: DataFrame) -> DataFrame:
    """(host, pages, root, nested, masses): tokens of the root class, (container, tokens) of each valid class nested below it, and (path, chars, links) of containers of text.

    pages: (host, mark, html), mark being a seeded hash of the page. All have no more entries than a few pages: a token is on SUPPORT of the pages."""
    v = pages.mapInArrow(_vectors, _VECTOR).groupBy("host", "token", "path").agg(F.sum("pages").alias("pages"), F.sum("total").alias("total"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    v = written(v, "vectors")
    hosts = v.where("token = ''").select("host", F.col("pages").alias("n_pages"))
    common = v.where("token <> ''").join(hosts, "host").where((F.col("n_pages") > 1) & (F.col("pages") >= SUPPORT * F.col("n_pages")))
    mass = common.where("token IN ('=', '@')").groupBy("host", "path").agg(F.sum(F.when(F.col("token") == "=", F.col("total"))).alias("chars"), F.sum(F.when(F.col("token") == "@", F.col("total"))).alias("links"))
    mass = mass.groupBy("host").agg(F.collect_list(F.struct("path", F.coalesce("chars", F.lit(0)).alias("chars"), F.coalesce("links", F.lit(0)).alias("links"))).alias("masses"))
    tokens = common.where("token NOT IN ('=', '@')").withColumn("text", F.col("path").startswith("#"))
    classes = tokens.groupBy("host", "n_pages", "text", "pages", "total", "x1", "x2").agg(F.collect_set(F.struct("token", "path")).alias("members"), F.min("path").alias("low"))
    often = F.col("pages") >= SHARE * F.col("n_pages")
    root = ~F.col("text") & (F.col("total") == F.col("pages")) & often
    within = F.forall("members", lambda m: (m["path"] == F.col("low")) | m["path"].startswith(F.concat(F.col("low"), F.lit("/"))))
    valid = ~F.col("text") & (F.col("total") > F.col("pages")) & within & (F.size("members") > 1)
    out = classes.groupBy("host", "n_pages").agg(
        F.flatten(F.collect_list(F.when(root, F.col("members.token")))).alias("root"),
        F.flatten(F.collect_list(F.when(F.col("text") & often, F.transform("members", lambda m: F.struct(m["token"].alias("token"), m["path"].alias("place"), F.col("pages").alias("pages")))))).alias("texts"),
        F.collect_list(F.when(valid, F.struct(F.col("low").alias("container"), F.col("members.token").alias("tokens")))).alias("nested"),
    )
    out = written(out.join(mass, "host", "left"), "templates")
    dropped(v)
    return out


def _extracted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, Template] = {}
    for b in it:
        texts = []
        columns = [b.column("host").to_pylist(), *(b.column(c) for c in ("root", "texts", "nested", "masses")), b.column("html").to_pylist()]
        for host, root, known, nested, masses, page in zip(*columns, strict=True):
            if host not in seen:
                if len(seen) > 1000:
                    seen.clear()
                seen[host] = Template(root.as_py() or (), [(x["token"], x["place"], x["pages"]) for x in known.as_py() or ()], [(x["container"], x["tokens"]) for x in nested.as_py() or ()], [(x["path"], x["chars"], x["links"]) for x in masses.as_py() or ()])
            texts.append(Walk(page).main_text(seen[host]) if page else "")
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of (page_id, url, html)."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of().alias("host"))
    marked = p.select("host", F.xxhash64(F.lit(5), "page_id", "url", "html").alias("mark"), "html")
    # tags of the root class count only if they hold the main text; AQE broadcasts the templates if they are small and splits a hot host if not
    root = F.filter("root", lambda x: x.rlike(_ARTICLE.pattern))
    t = templates(marked).select(F.col("host").alias("t_host"), root.alias("root"), "texts", "nested", "masses")
    return p.join(t, p.host == t.t_host, "left").select("page_id", "url", "host", "root", "texts", "nested", "masses", "html").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
