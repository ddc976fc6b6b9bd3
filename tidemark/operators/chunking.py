"""Splitting texts into chunks, and documents into rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where a text may be cut, the coarsest first, and how many characters stand for a token.
SEPARATORS = ("\n\n", "\n", "。", ". ", " ")
CHARS_PER_TOKEN = 3


def _pieces(text: str, most: int, separators: tuple[str, ...]) -> list[str]:
    if len(text) <= most:
        return [text] if text.strip() else []
    for i, mark in enumerate(separators):
        if mark in text:
            parts, rest = text.split(mark), separators[i + 1 :]
            break
    else:
        return [text[at : at + most] for at in range(0, len(text), most)]
    out, held = [], ""
    for part in parts:
        joined = f"{held}{mark}{part}" if held else part
        if len(joined) <= most:
            held = joined
            continue
        if held.strip():
            out.append(held)
        if len(part) > most:
            out += _pieces(part, most, rest)
            held = ""
        else:
            held = part
    return out + ([held] if held.strip() else [])


def split_text(text: str, most_tokens: int = 512, overlap_tokens: int = 50) -> list[str]:
    """Chunks of at most so many tokens; each but the first begins with the end of the one before, overlap included."""
    chunks = _pieces(text, most_tokens * CHARS_PER_TOKEN, SEPARATORS)
    tail = overlap_tokens * CHARS_PER_TOKEN
    for i in range(1, len(chunks)):
        if tail:
            chunks[i] = chunks[i - 1][-tail:] + chunks[i]
    return chunks


_HEADING = re.compile(r"^(#{1,6})\s+(.*)$")


def split_markdown(text: str, title: str = "", most_tokens: int = 512) -> list[tuple[str, str]]:
    """(heading path, chunk): sections under their headings; tables and code stay whole, long prose is split further."""
    most, path, out, held, kind = most_tokens * CHARS_PER_TOKEN, [], [], [], ""

    def flush() -> None:
        body = "\n".join(held).strip()
        held.clear()
        if not body:
            return
        where = " > ".join([p for p in [title, *(h for _, h in path)] if p])
        parts = [body] if kind in ("table", "code") or len(body.encode()) <= most else split_text(body, most_tokens, 0)
        out.extend((where, f"【{where}】\n{p}" if where else p) for p in parts)

    for line in text.split("\n"):
        fence, heading = line.lstrip().startswith("```"), _HEADING.match(line)
        if kind == "code":
            held.append(line)
            if fence:
                flush()
                kind = ""
            continue
        if heading:
            flush()
            kind = ""
            level = len(heading[1])
            path[:] = [p for p in path if p[0] < level] + [(level, heading[2].strip())]
            continue
        now = "code" if fence else "table" if line.lstrip().startswith("|") else "prose"
        if now != kind and held:
            flush()
        kind = now
        held.append(line)
    flush()
    return out


class _Text(HTMLParser):
    """The text of an HTML page, with a line break after blocks, without scripts and styles."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        self.hidden = max(0, self.hidden - (tag in ("script", "style")))
        if tag in ("p", "div", "li", "tr", "br", "title", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def html_text(html: str | None) -> str:
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return re.sub(r"[ \t]+", " ", re.sub(r"\s*\n\s*", "\n", "".join(parser.parts))).strip()


def chunks(docs: DataFrame, key: str, text: str, markdown: bool = False, **options) -> DataFrame:
    """(key, at, heading, chunk) of each row's text; nulls have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part, rows = batch.slice(at, 200), []
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = split_markdown(t or "", **options) if markdown else [("", c) for c in split_text(t or "", **options)]
                    rows += [(k, i, h, c) for i, (h, c) in enumerate(found)]
                cols = list(zip(*rows)) or [(), (), (), ()]
                kinds = (part.column(0).type, pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [key, "at", "heading", "chunk"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {kind}, at int, heading string, chunk string")


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, text) of HTML pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([html_text(h) for h in batch.column(1).to_pylist()], pa.string())], ["page_id", "text"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, text string")
