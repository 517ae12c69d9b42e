"""Main text of web pages by equivalence classes of template tokens.

Pages become sequences of structural tokens: a token is an element with its names and the structural elements
around it. Over the pages of a host, a token's occurrence vector says how often each page has it; tokens
with one vector form an equivalence class (kept as a mergeable fingerprint, so no host's pages ever meet in one task).
The class that occurs once in every page is the root of the host's template, in the order that all pages have; a token that breaks it is left out of it.
Occurrences of other tokens are told apart by the gap of the root they stand in, which gives them roles of their own, with vectors and classes of their own;
roles that are once in every page join the root, which divides the gaps anew, until no host's root grows. Classes that occur once in each of fewer pages
nest below the template tokens that enclose them. A template token that holds other elements is a slot, with the text that no
slot within it holds. A slot whose text does not vary between the host's pages is template and dropped, but one in an article or main element only
on the word of FEW pages at least; names are a hint: they mark noise, and of a page's varying slots those in articles and in main
elements, else those in elements named so, are its main text. Pages that mostly consist of one article are one page as evidence, whatever stands beside it.

Tags are read as HTML reads them: a quote counts only where a value begins, an open quote that nothing closes is a letter, and a tag or comment
without an end reaches to the end of the page. Each letter is read a fixed number of times; elements beyond DEPTH belong to the one around them.

Defined cases: null or empty html gives an empty text; a null or odd url is a host of its own (""); a page alone on its
host is judged by its elements' names and its text alone, and so is a page none of whose slots varies; text within a slot that varies is
never dropped for being repeated; equal pages give equal rows, and pages of equal text (noise left out) are one page of their host as evidence; an empty table gives no rows; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_SPACE = r"[ \t\n\r\f]"
_ATTRIBUTE = rf"""[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+(?:{_SPACE}*+={_SPACE}*+(?:"[^"]*+"|'[^']*+'|[^ \t\n\r\f"'>][^ \t\n\r\f>]*+)?+)?+"""
_TOKEN = re.compile(rf"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^ \t\n\r\f/>]*+)((?:[ \t\n\r\f/]++|{_ATTRIBUTE})*+)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""(?ai)\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: The parts of names that number a page or an element: they would keep pages from sharing tokens.
_NUMBERED = re.compile(r"(?=[a-f]*[0-9])[0-9a-f]{8,}|[0-9]{3,}")
#: Elements whose content is not text of the page.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "canvas", "xmp")
_END = {tag: re.compile(rf"</{tag}(?=[ \t\n\r\f/>])[^>]*+(?:>|\Z)", re.I) for tag in RAW}
#: Elements that end a block.
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul caption video audio".split()
)
#: Elements that close an open one of the same kind where they begin (their end tags may be left out).
SIBLINGS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSES_P = BLOCK - {"html", "body", "head", "title", "option", "button", "legend", "summary", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
_VOID = ("hr",)
#: Elements that can be slots; headings, paragraphs, lists and tables belong to the slot around them.
SLOT_TAGS = frozenset("body div section main article center".split())
#: Open elements at most; those within belong to the last.
DEPTH = 512
#: Pages that must agree before a slot in an article or main element is template.
FEW = 4
#: A template token lies in one of so many pages of its host at least; a slot is template where its pages have one text, or one for so many pages.
SHARE = 8
#: Slots of all hosts together that may be broadcast; more are joined.
MOST_SLOTS = 200_000
#: Elements and names that are never main text.
NOISE_TAGS = ("head", "nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "fieldset", "legend", "title")
NOISE_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert
    sidebar side-bar aside rail menu nav navigation navbar breadcrumb breadcrumbs footer header masthead comment comments commentlist reply replies disqus respond
    share sharing social related recommended newsletter subscribe signup popup modal overlay toolbar pagination pager search login widget widgets complementary contentinfo""".split()
)


#: Names of what holds other things: beside one of NOISE_NAMES they do not change what it says.
HOLDER_NAMES = frozenset("area article articles bar block body bottom box btn button buttons container content entry group head heading holder icon icons inline inner item items label left link links list main module off outer page panel post posts right row section side site slot spot story stories text title top unit wrap wrapper zone".split())


def _element(tag: str, attributes: str) -> str:
    names = sorted({_NUMBERED.sub("#", n) if any(c.isdigit() for c in n) else n for m in _NAMES.finditer(attributes) for n in (m[2] or m[3] or m[4] or "").lower().split()}) if "=" in attributes else []
    return ".".join([tag, *names])


def blocks(page: str, opened: Counter | None = None, sequence: list[str] | None = None, around: list[list[int]] | None = None) -> list[tuple[str, str]]:
    """(path, text) of each block in page order; a path is the structural elements around it, outermost first.

    opened counts the elements by path; sequence gets their paths as they open, around the places there of the elements around each block.
    """
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # tag, path so far
    places: list[int] = []  # of the elements in stack
    n_opened = 0
    held: Counter[str] = Counter()  # of the tags in stack
    beyond: Counter[str] = Counter()  # of the tags that are open beyond DEPTH
    parts: list[str] = []
    at = 0

    def end_block() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((stack[-1][1] if stack else "", text))
                if around is not None:
                    around.append(places.copy())

    def close() -> str:
        tag = stack.pop()[0]
        places.pop()
        held[tag] -= 1
        return tag

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in RAW:
            if not m[1] and not m[3].endswith("/"):
                end = _END[tag].search(page, at)
                at = end.end() if end else len(page)
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK:
            end_block()
            if m[1]:
                if beyond[tag]:
                    beyond[tag] -= 1
                elif held[tag]:
                    beyond.clear()
                    while close() != tag:
                        pass
                continue
            if tag in CLOSES_P and stack and stack[-1][0] == "p":
                close()
            if tag in SIBLINGS:
                while stack and stack[-1][0] in SIBLINGS[tag]:
                    close()
            if tag in _VOID:
                continue
            if len(stack) >= DEPTH:
                beyond[tag] += 1
                continue
            stack.append((tag, f"{stack[-1][1] if stack else ''}/{_element(tag, m[3])}"))
            held[tag] += 1
            places.append(n_opened)
            n_opened += 1
            if opened is not None:
                opened[stack[-1][1]] += 1
            if sequence is not None:
                sequence.append(stack[-1][1])
    if at < len(page):
        parts.append(page[at:])
    end_block()
    return out


def _noisy(name: str, inside: bool) -> bool:
    """Whether a name marks noise. Inside an article or main element all of its parts must: a share price or an ad hoc group is text."""
    parts = [x for x in re.split(r"[-_]", name) if x]
    found = name in NOISE_NAMES or any(x in NOISE_NAMES for x in parts)
    return found and (not inside or name in NOISE_NAMES or all(x in NOISE_NAMES or x in HOLDER_NAMES or x == "#" for x in parts))


def is_noise(path: str) -> bool:
    inside = False
    for element in path.split("/")[1:]:
        tag, *names = element.split(".")
        if tag in NOISE_TAGS or tag == "header" and not inside:
            return True
        if tag not in ("html", "body", "article", "main") and any(_noisy(name, inside) for name in names):
            return True
        inside |= tag in ("article", "main")
    return False


def region(path: str) -> str:
    """article, main, named (only a name says main), noise, or open: what a path's elements and their names say."""
    if is_noise(path):
        return "noise"
    tags = [e.split(".")[0] for e in path.split("/")[1:]]
    if "article" in tags or ".articlebody" in path:
        return "article"
    return "main" if "main" in tags else "named" if re.search(r"\.main(/|\.|$)", path) else "open"


def home(path: str) -> str:
    """The innermost element around a block that can be a slot, closed by a slash. An article or main element that a hint names is not parted further."""
    kind, elements = region(path), path.split("/")[1:]
    at = 0
    for i, element in enumerate(elements, 1):
        tag, *names = element.split(".")
        at = i if tag in SLOT_TAGS else at
        if kind == "article" and (tag == "article" or "articlebody" in names) or kind in ("main", "named") and (tag == "main" or "main" in names):
            at = i
            break
    return "".join(f"/{e}" for e in elements[:at]) + "/"


#: A block's around are the places, in the page's sequence, of the elements that make its home.
TOKENS = "page_id long, url string, host string, page_hash long, blocks array<struct<path:string, region:string, home:string, text:string, around:array<int>>>, opened array<struct<path:string, n:long>>, sequence array<string>"
_BLOCK_TYPE = pa.list_(pa.struct([("path", pa.string()), ("region", pa.string()), ("home", pa.string()), ("text", pa.string()), ("around", pa.list_(pa.int32()))]))
_OPENED_TYPE = pa.list_(pa.struct([("path", pa.string()), ("n", pa.int64())]))
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def compared(own: list[dict]) -> list[dict]:
    """What makes a page another page than the others of its host: its article where that is half of its text or more, else all but noise."""
    text = [b for b in own if b["region"] != "noise"]
    article = [b for b in text if b["region"] == "article"]
    size = lambda of: sum(len(b["text"]) for b in of)
    return article if article and 2 * size(article) >= size(text) else text


def _tokens(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    known: dict[str, tuple[str, str]] = {}
    for batch in rows:
        n = batch.num_rows
        for i in range(0, n, 256):
            part = batch.slice(i, 256)
            found, hashes, elements, sequences = [], [], [], []
            for page in part.column("html").to_pylist():
                page = page or ""
                own, opened, sequence, around = [], Counter(), [], []
                for (path, text), places in zip(blocks(page, opened, sequence, around), around, strict=False):
                    if path not in known:
                        if len(known) > 50_000:
                            known.clear()
                        known[path] = region(path), home(path)
                    own.append({"path": path, "region": known[path][0], "home": known[path][1], "text": text, "around": places[: known[path][1].count("/") - 1]})
                found.append(own)
                sequences.append(sequence)
                elements.append([{"path": k, "n": n} for k, n in opened.items()])
                raw = "\n".join(f"{b['home']}\t{b['text']}" for b in compared(own)).encode("utf-8", "surrogatepass")
                hashes.append(int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big", signed=True))
            urls = part.column("url").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id").cast(pa.int64()), pa.array(urls, pa.string()), pa.array(map(host_of, urls), pa.string()), pa.array(hashes, pa.int64()), pa.array(found, _BLOCK_TYPE), pa.array(elements, _OPENED_TYPE), pa.array(sequences, pa.list_(pa.string()))],
                names=["page_id", "url", "host", "page_hash", "blocks", "opened", "sequence"],
            )


def tokenised(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", "html").mapInArrow(_tokens, TOKENS)


def equivalence_classes(tokens: DataFrame) -> DataFrame:
    """host, path, pages, n, fingerprint, host_pages, in_root: structural tokens and their class over the host's pages.

    The fingerprint is the sum over pages of occurrences times a hash of the page: equal for tokens with equal
    occurrence vectors, and summed before the shuffle. Pages of equal text (page_hash, which leaves noise out) count as one. Tokens of the root class are once in every page.
    """
    own = tokens.select("host", F.col("page_hash").alias("page"), "opened")
    per_page = own.select("host", "page", F.explode("opened").alias("o")).groupBy("host", "page", "o.path").agg(F.max("o.n").alias("n"))
    by_token = per_page.groupBy("host", "path").agg(
        F.count("*").alias("pages"), F.sum("n").alias("n"), F.sum((F.pmod(F.xxhash64("page"), F.lit(1 << 40)) * F.col("n")).cast("decimal(38,0)")).alias("fingerprint")
    )
    hosts = own.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("host_pages"))
    return by_token.join(hosts, "host").withColumn("in_root", (F.col("pages") == F.col("host_pages")) & (F.col("n") == F.col("pages")))


def template(classes: DataFrame) -> DataFrame:
    """host, slot, fingerprint and in_root: the slots of each host's template, tokens that are once in each page of their class.

    Slots nest by their paths. A host has SHARE times its pages' mean number of tokens at most, however many pages it has.
    """
    once = (F.col("n") == F.col("pages")) & (F.col("pages") >= 2) & (F.col("pages") * SHARE >= F.col("host_pages"))
    return classes.where(once & F.regexp_extract("path", "([^/.]+)[^/]*$", 1).isin(*SLOT_TAGS)).select("host", F.concat("path", F.lit("/")).alias("slot"), "fingerprint", "in_root")


# ---- Roles


def roles(sequence: list[str], rounds: list[set[str]]) -> list[str]:
    """The tokens of a page as roles: in each round, what is not of the root is told apart by the root's token that opened last before it."""
    for root in rounds:
        last, out = None, []
        for role in sequence:
            if role in root:
                last = role
            elif last is not None:
                role = f"{role.split('.@', 1)[0]}.@{zlib.crc32(last.encode('utf-8', 'surrogatepass')):08x}"
            out.append(role)
        sequence = out
    return sequence


def _each_page(rows: DataFrame, kept: list[str], run: Callable[[dict, list[set[str]]], dict], added: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """rows (with rounds, the root of their host after each round, and slots) with the kept columns and those that run makes of a page's row."""
    schema = rows.schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[set[str]]] = {}
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                part, out = whole.slice(i, 256), []
                for row in part.select([c for c in part.schema.names if c not in ("page_id", "url")]).to_pylist():
                    if row["host"] not in known:
                        if len(known) > 1000:
                            known.clear()
                        known[row["host"]] = [set(r) for r in row["rounds"] or []]
                    out.append(run(row, known[row["host"]]))
                cols = [part.column(c) for c in kept] + [pa.array([x[n] for x in out], t) for n, t, _ in added]
                yield pa.RecordBatch.from_arrays(cols, names=[*kept, *(n for n, _, _ in added)])

    return rows.mapInArrow(each, ", ".join([f"{c} {schema[c].dataType.simpleString()}" for c in kept] + [f"{n} {t}" for n, _, t in added]))


def _counted(row: dict, rounds: list[set[str]]) -> dict:
    own = roles(row["sequence"], rounds)
    root = rounds[-1] if rounds else set()
    return {"opened": [{"path": k, "n": n} for k, n in Counter(own).items()], "ranks": [{"path": role, "rank": rank} for rank, role in enumerate(r for r in own if r in root)]}


_RANKS = pa.list_(pa.struct([("path", pa.string()), ("rank", pa.int32())]))
_COUNTED = [("opened", _OPENED_TYPE, "array<struct<path:string, n:long>>"), ("ranks", _RANKS, "array<struct<path:string, rank:int>>")]


def _sized(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """A row a host with rounds, its number of tokens in them (many_) and of pages, copies included (rows_)."""
    return rows.join(tokens.groupBy("host").agg(F.count("*").alias("rows_")), "host")


def differentiated(tokens: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """The classes of roles, and host, rounds, many_ and rows_: the root of each host with several pages after each round.

    A token of the root class whose place among them is not the same in all pages breaks their order and is left out. A round is
    added as long as some host's root grows, and each adds a role of its pages at least.
    """
    classes = common.cut(equivalence_classes(tokens), "classes")
    rounds, before = None, 0
    while True:
        root = classes.where("in_root and host_pages >= 2").groupBy("host").agg(F.collect_list("path").alias("root"))  # as many as one page has
        found = root.select("host", "root") if rounds is None else root.join(rounds.select("host", "rounds"), "host", "full")
        tried = F.array(F.col("root")) if rounds is None else F.concat(F.coalesce("rounds", F.array().cast("array<array<string>>")), F.array(F.coalesce("root", F.array().cast("array<string>"))))
        next_ = common.cut(_sized(found.select("host", tried.alias("rounds")).withColumn("many_", F.size(F.flatten("rounds"))), tokens), "tried")
        seen = _each_page(_with_slots(tokens.select("host", "page_hash", "sequence"), next_, total, "page_hash", "inner", "rounds"), ["host", "page_hash"], _counted, _COUNTED)
        ordered = seen.select("host", F.explode("ranks").alias("r")).groupBy("host", "r.path").agg((F.min("r.rank") == F.max("r.rank")).alias("steady")).where("steady")
        steady = ordered.groupBy("host").agg(F.collect_list("path").alias("root"))
        last = F.slice("rounds", 1, F.size("rounds") - 1)
        rounds = next_.join(steady, "host", "left").select("host", F.concat(last, F.array(F.coalesce("root", F.array().cast("array<string>")))).alias("rounds"), "rows_")
        rounds = common.cut(rounds.withColumn("many_", F.size(F.flatten("rounds"))), "rounds")
        size = rounds.agg(F.sum(F.size(F.element_at("rounds", -1)))).first()[0] or 0
        if size <= before:
            return classes, rounds
        before = size
        told = _each_page(_with_slots(tokens.select("host", "page_hash", "sequence"), rounds, total, "page_hash", "left", "rounds"), ["host", "page_hash"], _counted, _COUNTED)
        classes = common.cut(equivalence_classes(told), "classes")


# ---- Slots


def _of_host(rows: DataFrame, rounds: DataFrame, tokens: DataFrame, *columns: str) -> DataFrame:
    """A row a host with its rounds and slots (as many as template() allows), and its number of pages, copies included."""
    own = rows.groupBy("host").agg(F.collect_list(F.struct(*columns)).alias("slots"))
    both = own.join(rounds.select("host", "rounds"), "host", "left")
    return _sized(both.withColumn("many_", F.size("slots") + F.coalesce(F.size(F.flatten("rounds")), F.lit(0))), tokens)


def _with_slots(rows: DataFrame, table: DataFrame, total: int, by: str, how: str, *columns: str) -> DataFrame:
    """rows with columns of their hosts (a table of _of_host or rounds): broadcast up to MOST_SLOTS tokens, else joined, large hosts dealt to several tasks."""
    if (table.agg(F.sum("many_")).first()[0] or 0) <= MOST_SLOTS:
        return rows.join(F.broadcast(table.select("host", *columns)), "host", how)
    return common.spread_join(rows, table.select("host", *columns, "rows_"), ["host"], F.col("rows_") * common.OFTEN > total, by, how).drop("rows_")


def _placed(row: dict, rounds: list[set[str]]) -> dict:
    own, slots = roles(row["sequence"], rounds), {x["slot"]: x for x in row["slots"] or []}
    for b in row["blocks"]:
        b["slot"] = next((slot for at in reversed(b["around"]) if (slot := own[at] + "/") in slots), None)
        b["varies"] = slots[b["slot"]].get("content", True) if b["slot"] else True
    return {"placed": row["blocks"]}


_PLACED = [("placed", pa.list_(pa.struct([("region", pa.string()), ("home", pa.string()), ("text", pa.string()), ("slot", pa.string()), ("varies", pa.bool_())])), "array<struct<region:string, home:string, text:string, slot:string, varies:boolean>>")]


def slot_roles(tokens: DataFrame, slots: DataFrame, rounds: DataFrame, total: int) -> DataFrame:
    """host, slot and content: whether the slot's text varies between the host's pages. slots: those of template().

    A slot has the text of the blocks that lie in it and in no slot within it, compared as the mean hash of its blocks, which copies of a page leave as it is.
    """
    own = tokens.select("host", "page_hash", "sequence", F.expr("filter(blocks, b -> b.region <> 'noise')").alias("blocks"))
    pages = _with_slots(own, common.cut(_of_host(slots, rounds, tokens, "slot"), "host_slots"), total, "page_hash", "inner", "rounds", "slots")
    block = _each_page(pages, ["host", "page_hash"], _placed, _PLACED).select("host", F.col("page_hash").alias("page"), F.explode("placed").alias("b")).where("b.slot is not null")
    placed = block.select("host", "page", "b.slot", F.col("b.region").isin("article", "main").alias("inside"), F.xxhash64("b.home", "b.text").alias("text_hash"))
    texts = placed.groupBy("host", "page", "slot").agg((F.sum(F.col("text_hash").cast("decimal(38,0)")) / F.count("*")).alias("content"), F.max("inside").alias("inside"))
    each = texts.groupBy("host", "slot", "content").agg(F.count("*").alias("pages"), F.max("inside").alias("inside"))
    of = each.groupBy("host", "slot").agg(F.sum("pages").alias("pages"), F.count("*").alias("contents"), F.max("inside").alias("inside"))
    constant = (F.col("pages") >= F.when(F.col("inside"), FEW).otherwise(2)) & ((F.col("contents") == 1) | (F.col("contents") * SHARE <= F.col("pages")))
    return slots.select("host", "slot").join(of, ["host", "slot"], "left").select("host", "slot", F.coalesce(~constant, F.lit(True)).alias("content"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars: the main text of every page: its slots that vary, of these the ones in articles and main elements, else in what is named so, else all."""
    tokens = common.cut(tokenised(pages), "page_blocks")
    total = tokens.count()
    classes, rounds = differentiated(tokens, total)
    slots = common.cut(template(classes), "template_slots")
    table = common.cut(_of_host(slot_roles(tokens, slots, rounds, total), rounds, tokens, "slot", "content"), "slot_roles")
    own = tokens.select("page_id", "url", "host", "sequence", F.expr("filter(blocks, b -> b.region <> 'noise')").alias("blocks"))
    placed = _each_page(_with_slots(own, table, total, "page_id", "left", "rounds", "slots"), ["page_id", "url"], _placed, _PLACED)
    source = placed.withColumn("varying", F.expr("filter(placed, b -> b.varies)")).select("page_id", "url", F.expr("if(size(varying) > 0, varying, placed)").alias("source"))
    best = F.expr("case when exists(source, b -> b.region = 'article') then array('article', 'main') when exists(source, b -> b.region in ('main', 'named')) then array('main', 'named') else array('open') end")
    text = F.array_join(F.expr("transform(filter(source, b -> array_contains(best, b.region)), b -> b.text)"), "\n")
    return source.withColumn("best", best).select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
