"""Code examples from documentation pages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from textwrap import dedent

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import tags as tag_functions
from corpuslab.functions.text import WHITESPACE, first_truthy

IMPORT_LINE = "from manim import *"
SCENE_CLASS = "class\\s+([A-Za-z_][A-Za-z0-9_]*)\\s*\\("
DEFAULT_LICENSE = "MIT"
REQUIRED = ("case_id", "source_url", "source_anchor", "prompt")


class _Blocks(HTMLParser):
    """The ids of a page, each with the text of the next ``pre`` that opens after it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.anchors: dict[str, int | None] = {}
        self.waiting: list[str] = []
        self.blocks: list[list[str]] = []
        self.open: list[int] = []
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("script", "style"):
            self.silent += 1
        if tag == "pre":
            for anchor in self.waiting:
                self.anchors[anchor] = len(self.blocks)
            self.waiting = []
            self.open.append(len(self.blocks))
            self.blocks.append([])
        name = dict(reversed(attrs)).get("id")
        if name and name not in self.anchors:
            self.anchors[name] = None
            self.waiting.append(name)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style") and self.silent:
            self.silent -= 1
        if tag == "pre" and self.open:
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            for block in self.open:
                self.blocks[block].append(data)


def page_blocks(html: str) -> list[tuple[str, str | None]]:
    """``(anchor, code)`` of a page; the code is null where no ``pre`` follows the anchor."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    texts = [dedent("".join(b)).strip() for b in parser.blocks]
    return [(anchor, None if at is None else texts[at]) for anchor, at in parser.anchors.items()]


def anchored_blocks(pages: DataFrame, url: str = "url", html: str = "html", version: Sequence[str] = ()) -> DataFrame:
    """``(source_url, *version, source_anchor, block)`` for every id of every page; each page is parsed once.

    Where several pages have the same URL (and version), an id is taken from the one with the least digest that has it.
    """
    keys = ["source_url", *version]
    columns = [*keys, "_digest", "source_anchor", "block"]
    given = pages.select(F.col(url).alias("source_url"), *version, F.sha2(html, 256).alias("_digest"), F.col(html).alias("html"))
    kinds = dict(given.dtypes)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (*key, anchor, code)
                for *key, text in zip(*[batch[c] for c in (*keys, "_digest", "html")]) if text is not None
                for anchor, code in page_blocks(text)
            ]
            yield pd.DataFrame(rows, columns=columns)

    schema = ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in columns)
    return given.mapInPandas(parse, schema).groupBy(*keys, "source_anchor").agg(F.min_by("block", "_digest").alias("block"))


def page_lookup(manifest: DataFrame, pages: DataFrame, url: str = "url", html: str = "html", version: Sequence[str] = ()) -> DataFrame:
    """Manifest rows with the page they name, each once, and whether it is ``found``: a page may be there without text.

    ``version`` are columns of both tables that tell pages with the same URL apart. Where several are left, the one with
    the least digest stands for them. A null key names the page whose key is null.
    """
    keys = ["source_url", *version]
    renamed = pages.withColumnRenamed(url, "source_url")
    rest = [c for c in renamed.columns if c not in keys]
    order = F.struct(F.col(html).isNull(), F.sha2(html, 256), F.xxhash64(*rest))
    single = renamed.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_page"))
    single = single.select(*[F.col(c).alias(f"_of_{c}") for c in keys], "_page")
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys]
    return manifest.join(single, same, "left").select(*manifest.columns, "_page.*", F.col("_page").isNotNull().alias("found"))


def import_pages(manifest: DataFrame, pages: DataFrame, url: str = "url", html: str = "html", version: Sequence[str] = ()) -> DataFrame:
    """A case per manifest row, or a ``problem`` where its anchor, code or scene class is missing.

    ``version`` are columns of both tables that tell pages with the same URL apart. Only pages the manifest names are
    parsed. The pages' text goes to the parser and no further: what is joined with the manifest is the blocks, on URL,
    version and anchor.
    """
    named = pages.join(manifest.select(F.col("source_url").alias(url), *version).distinct(), [url, *version], "left_semi")
    blocks = anchored_blocks(named, url, html, version).withColumn("_found", F.lit(True))
    joined = manifest.join(blocks, ["source_url", *version, "source_anchor"], "left")
    block = F.col("block")
    code = F.when(F.startswith(block, F.lit(IMPORT_LINE)), block).otherwise(F.concat(F.lit(IMPORT_LINE + "\n\n"), block))
    scene = first_truthy(F.regexp_extract(F.col("completion"), SCENE_CLASS, 1))

    def optional(name: str, kind: str = "string"):
        return F.col(name) if name in manifest.columns else F.lit(None).cast(kind)

    return joined.withColumn("completion", code).select(
        "case_id", "prompt", "completion",
        F.coalesce(first_truthy(optional("entry_scene")), scene).alias("entry_scene"),
        *[tag_functions.or_empty(optional(c, "array<string>")).alias(c) for c in ("tags", "must_contain", "must_not_contain")],
        F.coalesce(optional("source_name"), F.col("case_id")).alias("source_name"), "source_url", "source_anchor",
        F.coalesce(optional("license"), F.lit(DEFAULT_LICENSE)).alias("license"),
        *[optional(c, "int").alias(c) for c in ("target_duration_seconds", "target_duration_tolerance_seconds")],
        F.when(F.col("_found").isNull(), "anchor not found").when(block.isNull(), "no code block after anchor").when(
            F.coalesce(first_truthy(optional("entry_scene")), scene).isNull(), "no scene class"
        ).alias("problem"),
    )


def manifest_violations(manifest: DataFrame) -> DataFrame:
    """``(case_id, missing)`` for each required manifest field that is absent."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]))
    return manifest.select("case_id", F.explode(missing).alias("missing"))


def page_titles(pages: DataFrame, html: str = "html", blank: str = WHITESPACE) -> DataFrame:
    """Title and first heading of a page, by pattern, without the characters of ``blank`` around them."""
    def element(tag: str):
        found = F.regexp_extract(F.col(html), f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
        return F.nullif(F.btrim(found, F.lit(blank)), F.lit(""))

    return pages.withColumns({"title": element("title"), "heading": element("h1")})
