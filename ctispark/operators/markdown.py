"""HTML documents as Markdown, by one fold over the elements as they close."""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctispark.operators.parse import BATCH, DEEPEST, SILENT, VOID, _Nodes

#: What gives nothing.
DROPPED = frozenset(("head", "nav", "header", "footer", "aside")) | SILENT
#: Elements whose text is taken without its marks, its pieces by single spaces.
FLAT = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th"))
MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*"}
GAPS = re.compile(r"\n{3,}")
MARKDOWN = "doc_id long, markdown string, error string"
_TYPES = {"doc_id": pa.int64(), "markdown": pa.string(), "error": pa.string()}


class _Markdown(_Nodes):
    """Each open element gathers what its children give (md) and its pieces of text (bits); it is rendered when it closes."""

    def __init__(self) -> None:
        super().__init__()
        self.root = self._frame("")

    @staticmethod
    def _frame(tag: str) -> dict:
        return {"tag": tag, "md": [], "raw": [], "bits": [], "items": [], "lines": [], "cells": [], "heads": False}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while self._closes(tag):
            self._close()
        if len(self.open) >= DEEPEST:
            raise ValueError(f"elements are nested more than {DEEPEST} deep")
        if tag == "br":
            self._into()["md"].append("\n")
        if tag not in VOID:
            self.open.append(self._frame(tag))

    def _into(self) -> dict:
        return self.open[-1] if self.open else self.root

    def handle_data(self, data: str) -> None:
        top = self._into()
        if top["tag"] not in SILENT:
            top["md"].append(data)
            top["raw"].append(data)
            if data.strip():
                top["bits"].append(data.strip())

    def _close(self) -> None:
        own = self.open.pop()
        tag, into = own["tag"], self._into()
        if tag in DROPPED:
            return
        inner, flat = "".join(own["raw"] if tag in ("pre", "code") else own["md"]), " ".join(own["bits"])
        into["bits"] += own["bits"]
        into["raw"] += own["raw"]
        if tag == "li" and into["tag"] in ("ul", "ol"):
            into["items"].append(flat)
        elif tag in ("td", "th"):
            line = next((o for o in reversed(self.open) if o["tag"] in ("tr", "table")), into)
            line["cells"].append(flat.replace("|", "\\|"))
            line["heads"] |= tag == "th"
        elif tag == "tr":
            table = next((o for o in reversed(self.open) if o["tag"] == "table"), into)
            table["lines"].append((own["cells"], own["heads"]))
        into["md"].append(self._rendered(tag, own, inner, flat))

    @staticmethod
    def _rendered(tag: str, own: dict, inner: str, flat: str) -> str:
        if tag[:1] == "h" and tag in FLAT:
            return f"\n{'#' * int(tag[1])} {flat}\n"
        if tag == "p":
            return f"\n{inner}\n"
        if tag in ("ul", "ol"):
            return "\n" + "\n".join(f"{f'{i}.' if tag == 'ol' else '-'} {item}" for i, item in enumerate(own["items"], 1)) + "\n"
        if tag == "table":
            lines = own["lines"] + ([(own["cells"], own["heads"])] if own["cells"] else [])
            shown = ["| " + " | ".join(cells) + " |" for cells, _ in lines]
            return "\n" + "\n".join([*shown[:1], *(["|" + "---|" * max(1, len(lines[0][0]))] if lines else []), *shown[1:]]) + "\n"
        if tag == "pre":
            return f"\n```\n{inner}\n```\n"
        if tag == "code":
            return f"`{inner}`"
        mark = MARKS.get(tag, "")
        return f"{mark}{inner}{mark}"

    def text(self) -> str:
        self.finish()
        return GAPS.sub("\n\n", "".join(self.root["md"])).strip()


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rendered(html: str) -> tuple[str | None, str | None]:
        try:
            parser = _Markdown()
            parser.feed(html)
            return parser.text(), None
        except Exception as reason:  # as for nodes: the other documents of the batch are rendered
            return None, f"{type(reason).__name__}: {reason}"

    for batch in batches:
        for a in range(0, batch.num_rows, BATCH // 100):
            part = batch.slice(a, BATCH // 100)
            found = [rendered(h) if h else (h, None) for h in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], list(_TYPES))


def html_to_markdown(docs: DataFrame, doc: str = "doc_id", html: str = "html") -> DataFrame:
    """(doc_id, markdown, error): headings, paragraphs, code and pipe tables as blocks, inline strong, emphasis and code, lists by the number of their item.

    Navigation, headers, footers, asides, the head and scripts give nothing,
    other elements what they hold. An item of a list is its whole text, what is
    nested in it included. A table has a line under its first row; pipes within
    cells are escaped. Null gives null, a document that can't be read null and
    the reason.
    """
    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(html).alias("html")).mapInArrow(_render, MARKDOWN)
