"""Page layout: operators whose state or fixpoint depends on a growing group work on one page at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .glyphs import visible_share

PAGE = ["version_id", "page_index"]
# line building, in heights of the line
DRIFT, BACK, GAP, SPACE = 0.3, 1.0, 1.5, 0.5
LEAST_VISIBLE = 0.5
NEAR, LEAST_SIDE, LEAST_FORM_SIDE, MOST_OF_PAGE = 3.0, 36.0, 12.0, 0.8
RULE_HEIGHT, RULE_WIDTH, SAME_EDGE = 2.0, 0.2, 0.02


def _lines_of(page: pd.DataFrame) -> pd.DataFrame:
    out, line = [], None
    for g in page.sort_values("seq").itertuples():
        height, mid = g.t - g.b, (g.t + g.b) / 2
        if line is not None:
            size = line["t"] - line["b"]
            same = abs(mid - (line["t"] + line["b"]) / 2) <= DRIFT * size or (height < 0.7 * size and g.b < line["t"] and g.t > line["b"])
            if same and line["r"] - g.l <= BACK * size and g.l - line["r"] <= GAP * size:
                if g.l - line["r"] > SPACE * size and not line["text"].endswith(" "):
                    line["text"] += " "
                line["text"] += g.text
                line["r"] = max(line["r"], g.r)
                if height > size:
                    line["t"], line["b"] = g.t, g.b
                continue
        line = {"line": len(out), "text": g.text, "l": g.l, "b": g.b, "r": g.r, "t": g.t}
        out.append(line)
    return pd.DataFrame(out).assign(**{k: page[k].iloc[0] for k in PAGE})[[*PAGE, "line", "text", "l", "b", "r", "t"]]


def build_lines(glyphs: DataFrame) -> DataFrame:
    """Glyphs (version_id, page_index, seq, text, l, b, r, t) as lines. Whether a glyph goes on with the
    open line depends on that line, so a page is read in order."""
    return glyphs.groupBy(*PAGE).applyInPandas(_lines_of, "version_id long, page_index int, line int, text string, l double, b double, r double, t double")


def _blocks_of(page: pd.DataFrame) -> pd.DataFrame:
    rows, block, last = [], -1, None
    for x in page.sort_values("line").itertuples():
        size = x.t - x.b
        if last is not None:
            gap, was = last.b - x.t, last.t - last.b
            new = abs(size - was) > 0.25 * max(size, was) or gap > 0.45 * size or gap < -0.5 * size or x.l > last.r or x.r < last.l or x.l - first > 0.6 * size and x.l - last.l > 0.6 * size
        if last is None or new:
            block, first = block + 1, x.l
        rows.append((block, x.line, x.text))
        last = x
    return pd.DataFrame(rows, columns=["block", "line", "text"]).assign(**{k: page[k].iloc[0] for k in PAGE})[[*PAGE, "block", "line", "text"]]


def build_blocks(lines: DataFrame) -> DataFrame:
    """Lines with the paragraph they belong to: a new one at a change of height, a gap, no overlap or an indent."""
    return lines.groupBy(*PAGE).applyInPandas(_blocks_of, "version_id long, page_index int, block int, line int, text string")


def grown_boxes(boxes: np.ndarray) -> np.ndarray:
    """A label for each box (l, b, r, t): boxes whose common hulls come within NEAR points share one.
    Hulls only grow, so the labels do not depend on the order of the boxes."""
    label = np.arange(len(boxes))
    while True:
        names, label = np.unique(label, return_inverse=True)
        low = np.full((len(names), 2), np.inf)
        high = np.full((len(names), 2), -np.inf)
        np.minimum.at(low, label, boxes[:, :2])
        np.maximum.at(high, label, boxes[:, 2:])
        touch = (low[:, None] - NEAR <= high[None, :]).all(axis=2)
        touch &= touch.T
        joined = np.argmax(touch, axis=1)  # the first hull that each one touches, itself at the latest
        if (joined == np.arange(len(names))).all():
            return label
        label = joined[label]


def _figures_of(page: pd.DataFrame) -> pd.DataFrame:
    kind = page["kind"]
    if len(page):
        page = page.assign(label=grown_boxes(page[["l", "b", "r", "t"]].to_numpy(float)), form=kind == "form", other=kind != "image", bare=(kind == "path") & ~page["filled"])
    g = page.groupby("label").agg(l=("l", "min"), b=("b", "min"), r=("r", "max"), t=("t", "max"), form=("form", "any"), other=("other", "any"), bare=("bare", "all"), n=("kind", "size"))
    wide, high = g["r"] - g["l"], g["t"] - g["b"]
    short = np.where(g["form"], LEAST_FORM_SIDE, LEAST_SIDE)
    fits = (np.maximum(wide, high) >= LEAST_SIDE) & (np.minimum(wide, high) >= short) & (wide * high <= MOST_OF_PAGE * page["width"].iloc[0] * page["height"].iloc[0])
    g = g[fits & ~(g["bare"] & (g["n"] < 2))].sort_values(["t", "l"], ascending=[False, True])
    source = np.where(~g["other"], "image", np.where(g["form"], "form", "vector"))
    return g.assign(source=source, **{k: page[k].iloc[0] for k in PAGE})[[*PAGE, "l", "b", "r", "t", "source"]]


def figure_candidates(graphics: DataFrame) -> DataFrame:
    """Figures of a page: visible graphics whose boxes, as they grow, come within three points of each
    other. Input: version_id, page_index, kind, l, b, r, t, filled, stroked, width, height and, if known, clips;
    of a graphic half must be seen within its clips."""
    if "clips" in graphics.columns:
        graphics = visible_share(graphics).filter(F.col("visible") >= LEAST_VISIBLE).drop("visible", "clips")
    seen = graphics.filter(((F.col("kind") != "path") | F.col("filled") | F.col("stroked")) & ((F.col("r") - F.col("l")) * (F.col("t") - F.col("b")) <= MOST_OF_PAGE * F.col("width") * F.col("height")))
    return seen.groupBy(*PAGE).applyInPandas(_figures_of, "version_id long, page_index int, l double, b double, r double, t double, source string")


def _rules_of(page: pd.DataFrame) -> pd.DataFrame:
    page = page.sort_values(["t", "l"], ascending=[False, True]).reset_index(drop=True)
    edges, slack = page[["l", "r"]].to_numpy(float), SAME_EDGE * page["width"].iloc[0]
    group, n = np.full(len(page), -1), 0
    while (group < 0).any():  # the topmost rule without a group takes all that share its edges
        head = edges[np.argmax(group < 0)]
        group[(group < 0) & (np.abs(edges - head) <= slack).all(axis=1)] = n
        n += 1
    return page.assign(rule_group=group)[[*PAGE, "rule_group", "l", "b", "r", "t"]]


def horizontal_rules(graphics: DataFrame) -> DataFrame:
    """Horizontal rules of a page in groups with the edges of their first one, top down."""
    thin = graphics.filter((F.col("kind") == "path") & (F.col("stroked") | F.col("filled")) & (F.col("t") - F.col("b") <= RULE_HEIGHT) & (F.col("r") - F.col("l") >= RULE_WIDTH * F.col("width")))
    return thin.groupBy(*PAGE).applyInPandas(_rules_of, "version_id long, page_index int, rule_group int, l double, b double, r double, t double")


def flag_tables(blocks: DataFrame, rules: DataFrame, most_lines: int = 2) -> DataFrame:
    """Blocks between two neighbouring rules of a group that no body paragraph shares: ``in_table``.

    blocks: version_id, page_index, p, text, l, b, r, t, n_lines in the coordinates of the rules. A
    band with three line numbers is pseudocode and keeps its members; captions are left out.
    """
    w = Window.partitionBy(*PAGE, "rule_group").orderBy(F.desc("t"))
    bands = rules.select(*PAGE, "rule_group", F.col("b").alias("top"), F.lead("t").over(w).alias("bottom"), F.col("l").alias("left"), F.col("r").alias("right")).filter("bottom is not null")
    mid_y, mid_x = (F.col("b") + F.col("t")) / 2, (F.col("l") + F.col("r")) / 2
    inside = blocks.join(bands, PAGE).filter((mid_y < F.col("top")) & (mid_y > F.col("bottom")) & mid_x.between(F.col("left"), F.col("right")))
    band = Window.partitionBy(*PAGE, "rule_group", "top")
    body = (F.col("n_lines") > most_lines) & (F.col("r") - F.col("l") >= 0.8 * (F.col("right") - F.col("left")))
    numbers = F.sum(F.size(F.regexp_extract_all("text", F.lit(r"(?:^|\s)(\d{1,3}):(?:\s|$)"), F.lit(1)))).over(band)
    kept = inside.withColumns({"body": F.max(body).over(band), "numbers": numbers}).filter((~F.col("body") | (F.col("numbers") >= 3)) & ~F.col("text").rlike(r"^(?:Fig\.|Figure|Table) +\d+[.:]"))
    return kept.select("version_id", "p").distinct()


def apply_layout(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Flags of blocks (version_id, page_index, p, text, x0, y0, x1, y1) from the best-scoring region
    label that covers half of each; captions keep none. A page number is header or footer by its place."""
    r = regions.select(*PAGE, "label", "score", F.col("x0").alias("a0"), F.col("y0").alias("b0"), F.col("x1").alias("a1"), F.col("y1").alias("b1"))
    wide = F.greatest(F.lit(0.0), F.least("x1", "a1") - F.greatest("x0", "a0"))
    high = F.greatest(F.lit(0.0), F.least("y1", "b1") - F.greatest("y0", "b0"))
    hit = blocks.join(r, PAGE).filter(wide * high >= 0.5 * (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    best = hit.groupBy("version_id", "p").agg(F.max_by("label", F.struct("score", "label")).alias("label"))
    flag = (
        F.when(F.col("text").rlike(r"^(?:Fig\.|Figure|Table) +\d+[.:]"), F.lit(None)).when(F.col("label").isin("table", "algorithm"), "in_table").when(F.col("label").startswith("formula"), "math")
        .when(F.col("label").isin("image", "chart", "seal"), "in_figure").when(F.col("label") == "header", "page_header").when(F.col("label") == "footer", "page_footer")
        .when(F.col("label") == "number", F.when(F.col("y0") + F.col("y1") < 1.0, "page_header").otherwise("page_footer"))
    )
    return blocks.join(best, ["version_id", "p"], "left").select("version_id", "p", flag.alias("flag"))


def _grown(group: pd.DataFrame) -> pd.DataFrame:
    """The hull of the seeds of one caption and of all parts that touch what was taken so far."""
    boxes = group[["x0", "y0", "x1", "y1"]].to_numpy(float)
    taken = group["seed"].to_numpy(bool).copy()
    while True:
        low, high = boxes[taken, :2].min(axis=0) - TOUCH, boxes[taken, 2:].max(axis=0) + TOUCH
        more = taken | ((boxes[:, :2] <= high) & (boxes[:, 2:] >= low)).all(axis=1)
        if (more == taken).all():
            break
        taken = more
    hull = [*(boxes[taken, :2].min(axis=0) - PAD), *(boxes[taken, 2:].max(axis=0) + PAD)]
    return pd.DataFrame([[group["version_id"].iloc[0], group["p"].iloc[0], *np.clip(hull, 0, 1)]], columns=["version_id", "p", "x0", "y0", "x1", "y1"])


TOUCH, PAD, REACH = 0.015, 0.005, 0.08


def figure_boxes(captions: DataFrame, parts: DataFrame) -> DataFrame:
    """The region of each caption (version_id, page_index, p, c0..c3): parts on its side of it that
    overlap it across and lie within reach are seeds, above before below; touching parts on that
    side join them. A caption's candidates are the parts of its page."""
    j = captions.join(parts.select(*PAGE, "x0", "y0", "x1", "y1"), PAGE)
    across = (F.col("x0") < F.col("c2")) & (F.col("x1") > F.col("c0"))
    above, below = (F.col("y1") <= F.col("c1")), (F.col("y0") >= F.col("c3"))
    j = j.withColumns({"side": F.when(above, 0).when(below, 1), "gap": F.when(above, F.col("c1") - F.col("y1")).when(below, F.col("y0") - F.col("c3"))}).filter("side is not null")
    j = j.withColumn("seed", across & (F.col("gap") <= REACH))
    w = Window.partitionBy("version_id", "p")
    chosen = j.withColumn("best", F.min(F.when(F.col("seed"), F.col("side"))).over(w)).filter(F.col("side") == F.col("best"))
    return chosen.select("version_id", "p", "x0", "y0", "x1", "y1", "seed").groupBy("version_id", "p").applyInPandas(_grown, "version_id long, p int, x0 double, y0 double, x1 double, y1 double")
