"""Text columns: stripping, document formatting, single-line safety, windows.

All are column expressions and stay inside generated code.
"""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Unicode and the C0 separators define it (wider than trim()).
SPACE = r"[\s\x0B\x1C-\x1F\x85\xA0  -     　]"
STRATEGIES = ("body_only", "title_body", "url_title_body", "tagged")


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at both ends; null stays null."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def words(c: Column) -> Column:
    """White-space words; an empty array for null and blank texts."""
    return F.filter(F.split(filled(c), f"{SPACE}+"), lambda w: w != "")


def single_line(c: Column) -> Column:
    """Tabs, carriage returns and line feeds each become a blank; null becomes empty."""
    return F.translate(filled(c), "\t\r\n", "   ")


def format_document(strategy: str, template: str = "<title>{title}</title><body>{body}</body>") -> Column:
    """One text of the columns docid, url, title, body.

    Fields are stripped and null counts as empty. ``tagged`` fills a template,
    which is parsed once here, so that braces in a field are never expanded.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; expected one of {STRATEGIES}")
    field = {c: strip(filled(F.col(c))) for c in ("url", "title", "body")} | {"docid": filled(F.col("docid"))}
    if strategy == "tagged":
        if not template:
            raise ValueError("an empty template formats nothing")
        parts: list[Column] = []
        for literal, name, _, _ in Formatter().parse(template):
            if literal:
                parts.append(F.lit(literal))
            if name is not None:
                if name not in field:
                    raise ValueError(f"the template names an unknown field {name!r}")
                parts.append(field[name])
        return F.concat(*parts)
    used = {"body_only": ("body",), "title_body": ("title", "body"), "url_title_body": ("url", "title", "body")}[strategy]
    return strip(F.concat_ws(" ", *[field[c] for c in used]))


def n_windows(n: Column, size: int, stride: int) -> Column:
    """How many windows of ``size`` every ``stride`` cover ``n`` tokens; at least one."""
    return F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / F.lit(stride)) + 1).cast("int")


def segment(df: DataFrame, text: str, size: int = 180, stride: int = 90) -> DataFrame:
    """A row for each window of white-space words, with ``passage_idx`` and ``passage``.

    A text without words gives one empty passage.
    """
    if not 0 < stride <= size:
        raise ValueError("the stride must be positive and at most the window")
    w = df.withColumn("_w", words(F.col(text)))
    w = w.withColumn("_k", F.explode(F.sequence(F.lit(0), n_windows(F.size("_w"), size, stride) - 1)))
    return w.withColumns({"passage_idx": F.col("_k"), "passage": F.array_join(F.slice("_w", F.col("_k") * stride + 1, F.lit(size)), " ")}).drop("_w", "_k")


def segment_with(df: DataFrame, text: str, encode: Callable[[str], list], decode: Callable[[list], str], size: int = 180, stride: int = 90) -> DataFrame:
    """The windows of :func:`segment` over the tokens of an injected tokenizer (``encode``, ``decode``), batch by batch.

    Null counts as empty; a text without tokens gives one empty passage.
    """
    if not 0 < stride <= size:
        raise ValueError("the stride must be positive and at most the window")
    fields = [f for f in df.schema.fields if f.name not in ("passage_idx", "passage")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", passage_idx int, passage string"

    def run(batches):
        for pdf in batches:
            made = []
            for t in pdf[text]:
                tokens = encode(t or "")
                starts = [0] if len(tokens) <= size else range(0, len(tokens) - size + stride, stride)
                made.append([decode(tokens[k : k + size]) for k in starts])
            n = [len(m) for m in made]
            out = pdf[[f.name for f in fields]].loc[pdf.index.repeat(n)].reset_index(drop=True)
            yield out.assign(passage_idx=[k for m in n for k in range(m)], passage=[p for m in made for p in m])

    return df.select(*[f.name for f in fields]).mapInPandas(run, schema)
