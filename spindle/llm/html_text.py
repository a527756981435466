"""Main text of web pages by wrappers inferred for each host."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.markup import Page
from spindle.llm.shared import staged
from spindle.llm.urls import url_parts
from spindle.llm.wrappers import aligned, in_article, main_slots, merged, wanted, wrapper_of

SALTS = 32  # shares of a host whose wrappers are aligned before those of the host
FRAME_PAGES, FRAME_SHARE = 3, 0.9  # different pages of a host, and the share of them, that have a text of its frame
BROADCAST = 32_000_000  # characters of all wrappers that may be broadcast; larger tables are joined by host


def _traits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What the pages of a batch show of their hosts' wrappers: the expression
    of each element (kind 0), the texts of each slot (kind 1) and, of pages
    without an article, which pages have a slot (kind 2) and exist (kind 3)."""
    for rows in batches:
        seen: dict[tuple, list[int]] = {}
        for host, html in zip(rows["host"], rows["html"], strict=True):
            page = Page(html)
            for path, zones in wrapper_of(page).items():
                seen.setdefault((host, 0, path, json.dumps(zones)), [0, 0, 0, 0, 0])
            slots: dict[str, list] = {}
            for path, text, _ in page.texts:
                if text.strip():
                    slots.setdefault(f"{path}/#text" if path else "#text", []).append(text)
            if not any(in_article(slot) for slot in slots):
                same = xxhash.xxh3_128_hexdigest(html.encode("utf-8", "replace"))
                seen[host, 3, "", same] = [0, 0, 0, 0, 0]
                seen.update({(host, 2, slot.rpartition("/")[0], same): [0, 0, 0, 0, 0] for slot in slots})
            for slot, texts in slots.items():
                chars = sum(len(t.strip()) for t in texts)
                value = xxhash.xxh3_64_intdigest("\n".join(texts).encode("utf-8", "replace")) >> 1
                linked = chars if "/a/" in f"/{slot}" or "/a." in f"/{slot}" else 0
                known = seen.setdefault((host, 1, slot.rpartition("/")[0], ""), [0, 0, 0, value, value])
                known[:] = [known[0] + 1, known[1] + chars, known[2] + linked, min(known[3], value), max(known[4], value)]
        yield pd.DataFrame([(*k, *v) for k, v in seen.items()], columns=["host", "kind", "path", "zones", "pages", "chars", "linked", "least", "most"])


TRAITS = "host string, kind int, path string, zones string, pages long, chars long, linked long, least long, most long"


def _of_share(rows: pd.DataFrame) -> pd.DataFrame:
    """The expressions of each element of a share of a host, as one."""
    rows = rows.sort_values(["path", "zones"])
    wrapper: dict[str, list] = {}
    for path, zones in zip(rows["path"], rows["zones"], strict=True):
        wrapper[path] = aligned(wrapper[path], json.loads(zones)) if path in wrapper else json.loads(zones)
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [json.dumps(wrapper)], "slots": ["{}"]})


def _of_host(rows: pd.DataFrame) -> pd.DataFrame:
    """The wrapper of a host from its shares, and its main slots."""
    wrapper: dict[str, list] = {}
    slots: dict[str, list] = {}
    for w, s in sorted(zip(rows["wrapper"], rows["slots"], strict=True)):
        wrapper = merged(wrapper, json.loads(w))
        slots |= json.loads(s)
    article, other = main_slots(wrapper, {p: (s[0], s[1], s[2], bool(s[3])) for p, s in slots.items()})
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [json.dumps(wrapper)], "article": [json.dumps(article)], "other": [json.dumps(other)]})


def infer_wrappers(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(host, wrapper, article, other): for each host the expression of every
    element, as JSON, and the slots of its main text.

    All pages take part. What they show is combined before it is shuffled: a
    host of any number of pages gives one row for each different expression and
    slot. These are aligned in shares of a host by path, and the shares put
    together, so no task holds a host's pages.
    """
    host = url_parts(F.col(url_column).cast("string"))[0]
    shown = pages.select(host.alias("host"), F.coalesce(F.col(html_column).cast("string"), F.lit("")).alias("html")).mapInPandas(_traits, TRAITS)
    sums = [F.sum(c).alias(c) for c in ("pages", "chars", "linked")]
    traits = staged(shown.groupBy("host", "kind", "path", "zones").agg(*sums, F.min("least").alias("least"), F.max("most").alias("most")), "traits")
    shares = traits.where("kind = 0").withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS))).groupBy("host", "salt").applyInPandas(_of_share, "host string, wrapper string, slots string")
    # rows that are copies of one page were combined to one
    having = traits.where("kind = 2").groupBy("host", "path").agg(F.count("*").alias("having"))
    different = traits.where("kind = 3").groupBy("host").agg(F.count("*").alias("different"))
    counted = having.join(different, ["host"]).select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), "having", "different")
    of_slot = F.col("host").eqNullSafe(F.col("of_host")) & (F.col("path") == F.col("of_path"))
    frame = (F.col("least") == F.col("most")) & (F.col("having") >= FRAME_PAGES) & (F.col("having") >= FRAME_SHARE * F.col("different"))
    slot = F.create_map("path", F.array("pages", "chars", "linked", F.coalesce(frame, F.lit(False)).cast("long")))
    slots = traits.where("kind = 1").join(counted, of_slot, "left").select("host", F.lit("{}").alias("wrapper"), F.to_json(slot).alias("slots"))
    return staged(shares.union(slots).groupBy("host").applyInPandas(_of_host, "host string, wrapper string, article string, other string"), "wrappers")


def main_texts(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), a row per row of `pages`.

    The text is that of the article: its blocks in page order, one to a line,
    with character references decoded and white space inside a block made one
    space. Menus, headers, footers, sidebars, notices, adverts, forms, scripts,
    styles and reader comments are left out, and nothing else. Pages without an
    article element give their densest part, as the pages of their host show it.
    Null and empty pages have an empty text; a null url, or one without ://,
    belongs to the host with the empty name. Repeated rows give equal texts, an
    empty table an empty result; other columns are not looked at.
    """
    host = url_parts(F.col(url_column).cast("string"))[0]
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), host.alias("host"), F.col(html_column).cast("string").alias("html"))
    slots = infer_wrappers(pages, url_column, html_column).select("host", F.struct("article", "other").alias("slots"))
    size = slots.agg(F.sum(F.length("slots.article") + F.length("slots.other"))).first()[0] or 0
    found = rows.join(F.broadcast(slots) if size <= BROADCAST else slots, "host", "left")

    def extract(html: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.Series]:
        known: dict[str, dict | frozenset] = {}
        for texts, named in html:
            out = []
            for text, article, other in zip(texts, named["article"], named["other"], strict=True):
                page = Page(text or "")
                blocks: list[str] = []
                for paths in (article, other):
                    if paths and not blocks:
                        if paths not in known:
                            if len(known) > 1000:
                                known.clear()
                            held = json.loads(paths)
                            known[paths] = held if isinstance(held, dict) else frozenset(held)
                        held = known[paths]
                        blocks = page.blocks(wanted(held, page.texts) if isinstance(held, dict) else held)
                out.append("\n".join(blocks))
            yield pd.Series(out, dtype=object)

    extract.__annotations__ = {"html": Iterator[tuple[pd.Series, pd.DataFrame]], "return": Iterator[pd.Series]}
    text = F.pandas_udf(extract, "string")("html", "slots")
    return found.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
