"""Pages of documents as a table function: one row a page, or one row with an error."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

PAGES = StructType().add("page", IntegerType()).add("source", StringType()).add("text", StringType()).add("error", StringType())
#: Pages and bytes of a document at most, and characters from which a page's own text is taken.
MAX_PAGES, MAX_BYTES, MIN_CHARS = 50, 50 << 20, 20


class DocumentPages:
    """``document_pages(data, parser[, max_pages[, max_bytes[, min_chars]]])``: (page, source, text, error).

    ``parser`` names a function "module:function" on the workers, from bytes to the list of the pages' own texts; it raises for
    data that it can't open. A page with ``min_chars`` characters or more has source "text"; any other "ocr" and a null text, to be recognised. A document that
    is null, too large, can't be opened, or has no or too many pages gives one row with an error and no page.
    """

    @staticmethod
    def analyze(data: AnalyzeArgument, parser: AnalyzeArgument, max_pages: AnalyzeArgument | None = None, max_bytes: AnalyzeArgument | None = None, min_chars: AnalyzeArgument | None = None) -> AnalyzeResult:
        if data.dataType.simpleString() not in ("binary", "void"):
            raise ValueError(f"document_pages reads binary data, not {data.dataType.simpleString()}")
        if not parser.isConstantExpression or not isinstance(parser.value, str) or parser.value.count(":") != 1:
            raise ValueError("the parser is a constant 'module:function'")
        for name, limit in (("max_pages", max_pages), ("max_bytes", max_bytes), ("min_chars", min_chars)):
            if limit is not None and (not limit.isConstantExpression or not isinstance(limit.value, int) or limit.value < 0):
                raise ValueError(f"{name} is a constant whole number from 0 on")
        return AnalyzeResult(schema=PAGES)

    def __init__(self):
        self.parsers = {}

    def eval(self, data: bytes | None, parser: str, max_pages: int = MAX_PAGES, max_bytes: int = MAX_BYTES, min_chars: int = MIN_CHARS):
        if parser not in self.parsers:
            module, function = parser.split(":")
            self.parsers[parser] = getattr(import_module(module), function)
        if data is None:
            yield None, None, None, "no data"
            return
        if len(data) > max_bytes:
            yield None, None, None, f"more than {max_bytes} bytes"
            return
        try:
            texts = self.parsers[parser](bytes(data))
        except Exception as e:
            yield None, None, None, f"not opened: {e}"[:200]
            return
        if not texts:
            yield None, None, None, "no pages"
        elif len(texts) > max_pages:
            yield None, None, None, f"more than {max_pages} pages"
        else:
            for page, text in enumerate(texts, 1):
                own = (text or "").replace("\r\n", "\n").strip()
                yield (page, "text", own, None) if len(own) >= min_chars else (page, "ocr", None, None)


def register_pages(spark: SparkSession, name: str = "document_pages") -> None:
    """Registers the table function for SQL: ``SELECT ... FROM files, LATERAL document_pages(content, 'module:function')``."""
    spark.udtf.register(name, udtf(DocumentPages))
