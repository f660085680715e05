"""How one text is cut into chunks: plain functions on strings, run by the batch operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

#: Fixed formats of the markdown.
PAGE_MARK = re.compile(r"## Página (\d+)")
PAGE_LINE = re.compile(r"\n## Página (\d+)\n")
HEADING = re.compile(r"(#{2,})\s+(.+)$")
RULE_ROW = re.compile(r"^\s*\|[\s:|-]+\|\s*$")


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in characters. strategy: fixed, semantic or hybrid; other names mean hybrid."""

    chunk_size: int = 1000
    overlap: int = 200
    min_size: int = 100
    max_size: int = 2000
    strategy: str = "hybrid"
    legacy_page: bool = False

    def __post_init__(self):
        if not 0 <= self.overlap < self.chunk_size:
            raise ValueError("overlap must be at least 0 and less than chunk_size")

    @property
    def kind(self) -> str:
        return {"fixed": "fixed", "fixed_size": "fixed", "semantic": "semantic"}.get(self.strategy, "hybrid")

    @classmethod
    def preset(cls, name: str, chunk_size: int | None = None) -> ChunkConfig:
        """Sizes of named runs (fixed values): web takes a size and derives its bounds."""
        if name == "web":
            size = chunk_size or 1000
            return cls(chunk_size=size, overlap=min(200, size - 1), min_size=200, max_size=4 * size)
        sizes = {"run": (1200, 200, 300, 2500, "hybrid"), "site": (1200, 150, 100, 2000, "semantic")}[name]
        return cls(**dict(zip(("chunk_size", "overlap", "min_size", "max_size", "strategy"), sizes)))

    @classmethod
    def for_tokens(cls, tokens: int, **more) -> ChunkConfig:
        """A size from a token budget: four characters a token, a fifth in reserve."""
        return replace(cls(**more), chunk_size=int(tokens * 4 * 0.8))


@dataclass
class Piece:
    content: str
    strategy: str
    page: int | None = None
    title: str | None = None
    start: int | None = None
    end: int | None = None


def fixed(text: str, cfg: ChunkConfig) -> Iterator[Piece]:
    """Windows of chunk_size that end behind a blank line, else a line break, near their end; they overlap."""
    start, size = 0, len(text)
    while start < size:
        end = start + cfg.chunk_size
        if end < size:
            for mark, reach in (("\n\n", 100), ("\n", 50)):
                at = text.find(mark, max(0, end - reach), end + reach)
                if at >= 0:
                    end = at + len(mark)
                    break
        content = text[start:end].strip()
        if len(content) >= cfg.min_size:
            yield Piece(content, "fixed_size", start=start, end=end)
        start = end - cfg.overlap if end - cfg.overlap > start else end


def sections(text: str) -> list[tuple[str | None, str]]:
    """(title, text) at each heading of level two or deeper; a part without any text is left out."""
    parts: list[tuple[str | None, list[str]]] = [(None, [])]
    for line in text.split("\n"):
        if head := HEADING.match(line):
            parts.append((head[2], []))
        parts[-1][1].append(line + "\n")
    return [(title, body) for title, lines in parts if (body := "".join(lines)).strip()]


def is_table(text: str) -> bool:
    """A markdown table (a rule row among the first three lines) or a LaTeX tabular, of two lines or more."""
    lines = text.strip().split("\n")
    if len(lines) < 2:
        return False
    return any(RULE_ROW.match(x) for x in lines[:3]) or "\\begin{tabular}" in text or "\\end{tabular}" in text


def pack(text: str, size: int, overlap: int) -> list[str]:
    """Paragraphs gathered up to a size; the next gathering starts with the last characters of the one before."""
    out, held = [], ""  # every paragraph held is followed by its blank line, which counts
    for para in filter(None, (p.strip() for p in text.split("\n\n"))):
        if held and len(held) + len(para) > size:
            out.append(held.strip())
            tail = held[-overlap:].strip() if overlap and not is_table(para) else ""
            held = f"{tail}\n\n" if tail else ""
        held += f"{para}\n\n"
    return [*out, held.strip()] if held.strip() else out


def _of_pages(pages: list[tuple[int | None, str]], cfg: ChunkConfig, whole: str, split: str) -> Iterator[Piece]:
    for page, text in pages:
        for title, body in sections(text):
            if len(body) > cfg.max_size:
                yield from (Piece(p, split, page, title) for p in pack(body, cfg.chunk_size, cfg.overlap))
            else:
                yield Piece(body, whole, page, title)


def semantic(text: str, cfg: ChunkConfig) -> Iterator[Piece]:
    """Sections of pages; a page's number is its mark's, or with legacy_page its place plus one."""
    cut = PAGE_LINE.split(text)
    marks = [None, *map(int, cut[1::2])]
    pages = [((k + 1 if k else None) if cfg.legacy_page else mark, part) for k, (mark, part) in enumerate(zip(marks, cut[::2]))]
    return _of_pages(pages, cfg, "semantic", "semantic_split")


def hybrid(text: str, cfg: ChunkConfig) -> Iterator[Piece]:
    """Sections of pages, whole up to max_size, larger ones packed."""
    cut = PAGE_MARK.split(text)
    return _of_pages(list(zip([None, *map(int, cut[1::2])], cut[::2])), cfg, "hybrid_semantic", "hybrid_split")


CHUNKERS: dict[str, Callable[[str, ChunkConfig], Iterator[Piece]]] = {"fixed": fixed, "semantic": semantic, "hybrid": hybrid}
