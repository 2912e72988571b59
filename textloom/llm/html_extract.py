"""Main text of web pages by the template that pages of a host share.

Each page is read once into tokens: tags, told apart by their place and classes, and whole blocks of text. Tokens that
come equally often on each page of a host (the same occurrence vector, kept as the exclusive or of hashes of (page,
count), which needs no page in order and pre-aggregates) are an equivalence class. Classes of two tokens or more that
occur on many pages are candidates; of these stay the ones that come in the same order on all pages and that nest in
the others, and together they are the host's template. A slot is the place after one token of a class: each text block
is in one. What markup says (article, menu, footer, advert, comments) is added up for each slot over the host's
pages, so a slot's text is judged by all pages; text that is itself part of the template, and slots that hold mostly
links, aren't the article's. Pages without hostmates are judged by their own markup.

Pages never shuffle by host: what is aggregated by host are tokens and slots, and a host's template, which is no larger
than twice a page, meets the pages by broadcast where it belongs to few hosts or to one with many pages.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from textloom.llm._arrays import lean
from textloom.llm._html import ASIDE, CONTENT, MAIN, OTHER, read_page
from textloom.llm._staging import fresh, join_groups, stage
from textloom.llm.url_filter import host_and_path

#: Pages of a host from which it has a template, and the least share of them (a half, as 1 / 2) that a class is on.
LEAST_PAGES, SHARE = 3, 2
#: Pages from which text may be part of the template, and the percent of pages that it is on at least.
TEXT_PAGES, TEXT_PERCENT = 5, 90
#: Hosts' templates broadcast whatever their pages.
FEW_HOSTS = 4096
#: Pages that a task holds read at a time.
PAGES_A_TIME = 64

_PAGE = "kinds array<long>, times array<int>, tokens array<long>, at array<int>, zones array<int>, chars array<int>, linked array<int>, texts array<string>"
_WALK_DDL, _SLOTS_DDL = "host string, class long, run array<long>, valid boolean", "host string, slot long, chars long, linked long, aside long, content long, main long, constant long"
_WALK = pa.schema([("host", pa.string()), ("class", pa.int64()), ("run", pa.list_(pa.int64())), ("valid", pa.bool_())])
_SLOTS = pa.schema([("host", pa.string()), ("slot", pa.int64()), *((n, pa.int64()) for n in ("chars", "linked", "aside", "content", "main", "constant"))])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
    names = ("kinds", "times", "tokens", "at", "zones", "chars", "linked", "texts")
    for batch in batches:
        for part in (batch.slice(k, PAGES_A_TIME) for k in range(0, batch.num_rows, PAGES_A_TIME)):
            read = []
            for html in part.column("html"):
                page = read_page(html.as_py())
                times = Counter(page[0])
                read.append((list(times), list(times.values()), *page))
            columns = [pa.array(list(values), pa.list_(kind)) for values, kind in zip(zip(*read, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=[*part.schema.names[:-1], *names])


def _walk(tokens: list[int], template: dict[int, int], runs: dict[int, list[int]]) -> tuple[list[tuple[int, int, int]], set[int]]:
    """(place, class, position in the class) of each template token in page order, where the class stands open from its
    first to its last token; and the classes that break that order or cross another. Those are left out."""
    broken: set[int] = set()
    while True:
        walk, open_, again = [], [], False
        for place, token in enumerate(tokens):
            kind = template.get(token)
            if kind is None or kind in broken:
                continue
            run = runs[kind]
            if open_ and open_[-1][0] == kind:
                step = open_[-1][1] + 1
            elif any(k == kind for k, _ in open_):
                inner = [k for k, _ in open_]  # those that stand open inside this class cross it
                broken.update(inner[inner.index(kind) + 1 :])
                again = True
                break
            else:
                step = 0
            if run[step] != token:
                broken.add(kind)
                again = True
                break
            if step == 0:
                open_.append((kind, 0))
            else:
                open_[-1] = (kind, step)
            walk.append((place, kind, step))
            if step == len(run) - 1:
                open_.pop()
        if not again and open_:
            broken.update(k for k, _ in open_)
            again = True
        if not again:
            return walk, broken


def _template(batch: pa.RecordBatch, name: str, seen: dict) -> Iterator[tuple[int, str, list]]:
    """(row, host, the host's template) of the rows that have one; a host's is read once a batch."""
    hosts, templates = batch.column("host").to_pylist(), batch.column(name)
    for row, host in enumerate(hosts):
        if host not in seen:
            seen[host] = templates[row].as_py()
        if seen[host] is not None:
            yield row, host, seen[host]


def _validate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class of a host, as a page shows it: the run of its tokens, and whether it is in order and nests."""
    for batch in batches:
        seen: dict = {}
        parsed: dict = {}
        found: set = set()
        tokens_of = batch.column("tokens")
        for row, host, classes in _template(batch, "classes", seen):
            if host not in parsed:
                parsed[host] = {t: c["class"] for c in classes for t in c["members"]}, {c["class"]: len(c["members"]) for c in classes}
            template, sizes = parsed[host]
            tokens = tokens_of[row].as_py()
            runs: dict[int, list[int]] = defaultdict(list)
            for token in tokens:
                kind = template.get(token)
                if kind is not None and len(runs[kind]) < sizes[kind]:
                    runs[kind].append(token)
            _, broken = _walk(tokens, template, runs)
            found.update((host, kind, tuple(run), kind not in broken and len(set(run)) == sizes[kind]) for kind, run in runs.items())
        hosts, kinds, runs_, valid = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(kinds, pa.int64()), pa.array([list(r) for r in runs_], pa.list_(pa.int64())), pa.array(valid, pa.bool_())], schema=_WALK)


class _Slots:
    """A host's template and the slots of text blocks in it."""

    def __init__(self, classes: list[dict]) -> None:
        self.runs = {c["class"]: c["run"] for c in classes}
        self.kinds = {t: c["class"] for c in classes for t in c["run"]}
        self.texts = {t for c in classes if c["constant"] for t in c["run"]}

    def of(self, tokens: list[int], at: list[int]) -> list[int]:
        """For each block the slot it is in: the token before it of the innermost class that stands open."""
        walk, broken = _walk(tokens, self.kinds, self.runs)
        out, open_, k = [], [0], 0
        for place in at:
            while k < len(walk) and walk[k][0] < place:
                _, kind, step = walk[k]
                run = self.runs[kind]
                if step:
                    open_[-1] = run[step]
                else:
                    open_.append(run[0])
                if step == len(run) - 1:
                    open_.pop()
                k += 1
            out.append(open_[-1])
        return out


def _sum_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict = {}
        parsed: dict = {}
        sums: dict = defaultdict(lambda: [0] * 6)
        columns = [batch.column(n) for n in ("tokens", "at", "zones", "chars", "linked")]
        for row, host, classes in _template(batch, "template", seen):
            slots = parsed.get(host) or parsed.setdefault(host, _Slots(classes))
            tokens, at, zones, chars, linked = (c[row].as_py() for c in columns)
            for slot, place, zone, n, m in zip(slots.of(tokens, at), at, zones, chars, linked, strict=True):
                for k, x in enumerate((n, m, n * (zone == ASIDE), n * (zone == CONTENT), n * (zone == MAIN), n * (zone != ASIDE and tokens[place] in slots.texts))):
                    sums[host, slot][k] += x
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in keys], pa.string()), pa.array([s for _, s in keys], pa.int64()), *(pa.array([sums[k][i] for k in keys], pa.int64()) for i in range(6))], schema=_SLOTS)


def _main_text(zones: list[int], chars: list[int], linked: list[int], texts: list[str], judged: list[int | None], constant: list[bool]) -> str:
    """The texts of the article: of the highest zone on the page. judged: what all pages say of a block's slot."""
    final = []
    for zone, n, m, slot, same in zip(zones, chars, linked, judged, constant, strict=True):
        if zone == OTHER and slot is not None:
            zone = slot
        elif zone == OTHER and 2 * m >= n:
            zone = ASIDE
        final.append(ASIDE if same else zone)
    top = max(final, default=ASIDE)
    return "\n".join(t for t, zone in zip(texts, final, strict=True) if zone == top) if top > ASIDE else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict = {}
        parsed: dict = {}
        out: list[str | None] = [None] * batch.num_rows
        columns = [batch.column(n) for n in ("tokens", "at", "zones", "chars", "linked", "texts")]
        for row, host, template in _template(batch, "template", seen):
            if host not in parsed:
                parsed[host] = _Slots(template["classes"]), {s["slot"]: s["zone"] for s in template["slots"]}, template["drops"]
            slots, verdicts, drops = parsed[host]
            tokens, at, zones, chars, linked, texts = (c[row].as_py() for c in columns)
            judged = [verdicts.get(s) for s in slots.of(tokens, at)]
            out[row] = _main_text(zones, chars, linked, texts, judged, [drops and tokens[p] in slots.texts for p in at])
        for row, text in enumerate(out):
            if text is None:
                zones, chars, linked, texts = (c[row].as_py() for c in columns[2:])
                out[row] = _main_text(zones, chars, linked, texts, [None] * len(zones), [False] * len(zones))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], names=["row", "text"])


def _by_host(classes: DataFrame, *columns: str) -> DataFrame:
    """(host, pages, classes) from a row for each class."""
    return stage(classes.groupBy("host").agg(F.max("pages").alias("pages"), F.collect_list(F.struct(*columns)).alias("classes")), "templates")


def _candidates(pages: DataFrame, total: int) -> DataFrame:
    """(host, pages, class, members, constant): equivalence classes of tokens that many of a host's pages have."""
    hosts = stage(pages.groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= LEAST_PAGES), "hosts")
    tokens = pages.select("host", "page", F.inline(F.arrays_zip("kinds", "times")))
    vectors = tokens.groupBy("host", "kinds").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("page", "times")).alias("x"), F.bit_xor(F.xxhash64("times", F.lit(1), "page")).alias("y"))
    shared = stage(vectors.filter(F.col("n") >= LEAST_PAGES / SHARE), "vectors")
    many = join_groups(shared, hosts, "host", "pages", total).filter(F.col("n") * SHARE >= F.col("pages"))
    classes = many.groupBy("host", "pages", "n", "x", "y").agg(F.collect_list("kinds").alias("members")).filter(F.size("members") > 1)
    constant = (F.col("pages") >= TEXT_PAGES) & (F.col("n") * 100 >= F.col("pages") * TEXT_PERCENT)
    return stage(classes.select("host", "pages", F.xxhash64("n", "x", "y").alias("class"), "members", constant.alias("constant")), "classes")


def extract_main_text(pages: DataFrame, html_column: str = "html", url_column: str = "url", keep: list[str] | None = None) -> DataFrame:
    """The rows (columns `keep`, by default all) with text, the page's main text, and n_chars, its code points.

    Main text is the article without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, markup
    and reader comments; its heading belongs to it. Character references are decoded, white space inside a block is one
    space, blocks are trimmed and joined in page order by a line feed. Null html, and html without such text, gives the
    empty string; a null url, or one without a host, has no hostmates. Repeated rows each count as a page. Names that
    `keep` has already get underscores appended. An empty table gives an empty result.
    """
    keep = pages.columns if keep is None else keep
    host = host_and_path(F.col(f"`{url_column}`"))[0]
    carried = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.struct(F.lit(None).cast("string").alias("none"))
    rows = pages.select(carried.alias("row"), F.when(host != "", host).alias("host"), F.monotonically_increasing_id().alias("page"), F.coalesce(F.col(f"`{html_column}`"), F.lit("")).alias("html"))
    schema = StructType([*rows.schema.fields[:-1], *StructType.fromDDL(_PAGE).fields])
    read = stage(rows.mapInArrow(lean(_read), schema), "pages")
    total = read.count()

    hosted = read.filter(F.col("host").isNotNull())
    classes = _candidates(hosted, total)
    met = join_groups(hosted.select("host", "tokens"), _by_host(classes, "class", "members"), "host", "pages", total, FEW_HOSTS)
    seen = met.filter(F.col("classes").isNotNull()).mapInArrow(lean(_validate), _WALK_DDL)
    valid = seen.groupBy("host", "class").agg(F.min("valid").alias("valid"), F.min("run").alias("run"), F.max("run").alias("most")).filter("valid and run = most")
    template = _by_host(classes.join(valid.select("host", "class", "run"), ["host", "class"]), "class", "run", "constant")

    met = join_groups(hosted.select("host", "tokens", "at", "zones", "chars", "linked"), template.withColumnRenamed("classes", "template"), "host", "pages", total, FEW_HOSTS)
    sums = met.filter(F.col("template").isNotNull()).mapInArrow(lean(_sum_slots), _SLOTS_DDL).groupBy("host", "slot").agg(*(F.sum(c).alias(c) for c in ("chars", "linked", "aside", "content", "main", "constant")))
    most = lambda c: 2 * c > F.col("chars")
    zone = F.when(most(F.col("aside")), ASIDE).when(most(F.col("main")), MAIN).when(most(F.col("main") + F.col("content")), CONTENT).when(2 * F.col("linked") >= F.col("chars"), ASIDE).otherwise(OTHER)
    drops = 2 * F.sum("constant") < F.sum(F.col("chars") - F.col("aside"))  # else pages of the host are copies of each other
    slots = sums.withColumn("zone", zone).groupBy("host").agg(F.collect_list(F.struct("slot", "zone")).alias("slots"), drops.alias("drops"))
    judged = stage(template.join(slots, "host").select("host", "pages", F.struct("classes", "slots", "drops").alias("template")), "judged")

    names = fresh(pages.select(*(f"`{c}`" for c in keep)), "text"), fresh(pages.select(*(f"`{c}`" for c in keep)), "n_chars")
    met = join_groups(read.drop("kinds", "times", "page"), judged, "host", "pages", total, FEW_HOSTS)
    out = met.mapInArrow(lean(_extract), StructType([read.schema["row"], StructField("text", StringType())]))
    return out.select(*([F.col(f"row.`{c}`") for c in keep]), F.col("text").alias(names[0]), F.length("text").cast("long").alias(names[1]))
