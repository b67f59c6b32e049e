"""Text functions as Spark expressions, and decoding of files in Python."""

from __future__ import annotations

import io
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_text(text: Column) -> Column:
    """Line ends to LF, ideographic and hard spaces to blanks, no blanks at line ends, at most one empty line, no white space around. Only white space changes."""
    x = F.regexp_replace(text, "\r\n?", "\n")
    x = F.translate(x, "　 ", "  ")
    x = F.regexp_replace(x, r"[ \t\f\x0b]+(?=\n|$)", "")
    x = F.regexp_replace(x, "\n{3,}", "\n\n")
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def garbled_ratio(text: Column) -> Column:
    """Share of U+FFFD and of control characters; 0 for null and empty texts."""
    n = F.length(text)
    return F.coalesce(F.when(n > 0, F.regexp_count(text, F.lit("[\\x{FFFD}\\x00-\\x08\\x0B-\\x1F]")) / n), F.lit(0.0))


def sentences(text: Column) -> Column:
    """Sentences with their end marks; a line feed ends one too."""
    found = F.regexp_extract_all(text, F.lit("([^。！？；!?;\n]*[。！？；!?;]|[^。！？；!?;\n]+)"), 1)
    return F.filter(F.transform(found, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


# ------------------------------------------------------------------ files
class _Text(HTMLParser):
    """Text of an HTML page; block elements break lines. Void elements open nothing, so an unclosed meta does not hide the page."""

    SILENT = frozenset(("script", "style", "noscript", "head", "title"))
    BREAK = frozenset("p div br li tr section article header footer h1 h2 h3 h4 h5 h6 blockquote table ul ol pre".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out = io.StringIO()
        self.silent = 0

    def _mark(self, tag: str) -> None:
        if tag in self.BREAK:
            self.out.write("\n")

    def handle_starttag(self, tag, attrs):
        self.silent += tag in self.SILENT
        self._mark(tag)
        if tag in ("td", "th"):
            self.out.write(" ")

    def handle_endtag(self, tag):
        if tag in self.SILENT and self.silent:
            self.silent -= 1
        self._mark(tag)

    def handle_data(self, data):
        if not self.silent and data.strip():
            self.out.write(data)


def html_text(page: str) -> str:
    p = _Text()
    p.feed(page)
    p.close()
    return p.out.getvalue()


def decode(data: bytes) -> str:
    """UTF-8 with or without a mark, else GB 18030, else UTF-8 with replacement."""
    for code in ("utf-8-sig", "gb18030"):
        try:
            return data.decode(code)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def pdf_text(data: bytes) -> str:
    """Needs a PDF library; without one the file waits with the status of a missing dependency."""
    import fitz  # noqa: PLC0415

    with fitz.open(stream=data, filetype="pdf") as doc:
        return "\n".join(page.get_text() for page in doc)


def read_file(name: str, data: bytes | None) -> tuple[str, str]:
    """(text, reason); the reason is empty where the text could be read."""
    suffix = "." + name.rpartition(".")[2].lower()
    if data is None:
        return "", "missing file"
    try:
        if suffix in (".html", ".htm"):
            return html_text(decode(data)), ""
        if suffix in (".txt", ".md", ".markdown"):
            return decode(data), ""
        if suffix == ".pdf":
            return pdf_text(data), ""
    except ImportError:
        return "", "dependency missing: PDF library"
    except Exception as e:  # noqa: BLE001 - one bad file must not end the batch
        return "", f"unreadable: {type(e).__name__}"
    return "", "unsupported format"
