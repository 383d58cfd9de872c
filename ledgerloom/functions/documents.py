"""Which document bodies can be trusted, and the invoice structs made from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .binding import bind
from .pages import format_pages, select_pages
from .tokens import text_tokens

INVOICE_TYPE = (
    "struct<kind:string,source:string,path_or_url:string,text:string,text_tokens:bigint,pages_read:string,page_count:int,"
    "sha256:string,size_bytes:bigint,read_path:string,est_input_tokens:bigint,error:string>"
)
_FIELDS = tuple(part.split(":")[0] for part in INVOICE_TYPE[len("struct<"):-1].split(","))
_PDF_MAGIC = "%PDF-"


def oversize(max_bytes: int) -> str:
    return f"oversize_>{max_bytes}_bytes"


def _too_large(size: Column, max_bytes: int | None) -> Column:
    return F.lit(False) if max_bytes is None else size > max_bytes


def invoice(**values: Column) -> Column:
    """An invoice struct; fields not given are null, but for the text's tokens."""
    if "text" in values:
        values.setdefault("text_tokens", text_tokens(values["text"]))
    return F.struct(*[values.get(name, F.lit(None)).alias(name) for name in _FIELDS]).cast(INVOICE_TYPE)


def null_invoice() -> Column:
    return invoice(kind=F.lit("none"), est_input_tokens=F.lit(0))


def unavailable_invoice(
    source: Column, path_or_url: Column, error: Column, size_bytes: Column | None = None, sha256: Column | None = None
) -> Column:
    """A referenced document that could not be read; the reason stays with the row."""
    known = {"size_bytes": size_bytes, "sha256": sha256}
    return invoice(
        kind=F.lit("error"), source=source, path_or_url=path_or_url, error=error, est_input_tokens=F.lit(0),
        **{k: v for k, v in known.items() if v is not None},
    )


def pdf_invoice(
    source: Column, path_or_url: Column, text: Column, page_count: Column, hint: Column, sha256: Column,
    size_bytes: Column, full_read: int | None = vocab.FULL_READ_PAGES, tokens: Column | None = None,
) -> Column:
    """`tokens`: the text's tokens, where the text itself is not at hand."""
    tokens = text_tokens(text) if tokens is None else tokens

    def build(pages: Column) -> Column:
        return invoice(
            kind=F.lit("pdf"), source=source, path_or_url=path_or_url, text=text, text_tokens=tokens, pages_read=format_pages(pages),
            page_count=page_count, sha256=sha256, size_bytes=size_bytes, read_path=F.lit("vision"),
            est_input_tokens=F.size(pages) * vocab.PAGE_TOKENS_HIGH + tokens,
        )

    return bind(select_pages(page_count, hint, full_read), build)


def looks_like_login(body: Column) -> Column:
    def marked(lowered: Column) -> Column:
        test = F.lit(False)
        for marker in vocab.LOGIN_MARKERS:
            test = test | lowered.contains(marker)
        return test

    return bind(F.lower(body), marked)


def classify_body(
    url: Column, content_type: Column, body: Column, page_count: Column, text: Column | None = None,
    max_bytes: int | None = vocab.INVOICE_MAX_BYTES, full_read: int | None = vocab.FULL_READ_PAGES,
) -> Column:
    """Trust test of a fetched body: size, then PDF, then HTML, then login walls in text, then everything else.

    `page_count` and `text` come from whatever decoded the PDF; `text` defaults to the body itself. Bodies over `max_bytes`
    are reported with their size instead of being read, windows over `full_read` pages are read at both ends; None: no limit.
    """
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    size, sha = F.octet_length(body), F.sha2(body, 256)
    here = F.lit("url")

    def rejected(reason: Column, with_sha: bool = True) -> Column:
        return unavailable_invoice(here, url, reason, size.cast("bigint"), sha if with_sha else None)

    readable_text = kind.contains("json") | kind.startswith("text/")
    as_text = invoice(
        kind=F.lit("text"), source=here, path_or_url=url, text=body, sha256=sha, size_bytes=size,
        read_path=F.lit("text"), est_input_tokens=text_tokens(body),
    )
    as_pdf = pdf_invoice(
        here, url, body if text is None else text, page_count, F.lit(None).cast("string"), sha, size, full_read
    )
    unsupported = F.concat(F.lit("unsupported_content_type: "), F.when(kind == "", "unknown").otherwise(kind))
    return (
        F.when(_too_large(size, max_bytes), rejected(F.lit(oversize(max_bytes or 0)), with_sha=False))
        .when(kind.contains("pdf") | body.startswith(_PDF_MAGIC), as_pdf)
        .when(kind.contains("html"), rejected(F.lit("html_response_possible_login_or_expired_url")))
        .when(readable_text & looks_like_login(body), rejected(F.lit("login_page_detected")))
        .when(readable_text, as_text)
        .otherwise(rejected(unsupported))
    )


def classify_file(
    path: Column, size_bytes: Column, head: Column, sha256: Column, page_count: Column, text: Column, hint: Column,
    max_bytes: int | None = vocab.INVOICE_MAX_BYTES, full_read: int | None = vocab.FULL_READ_PAGES,
    tokens: Column | None = None,
) -> Column:
    """Trust test of a local file: missing, then size, then the five leading bytes. Limits as for `classify_body`,
    `tokens` as for `pdf_invoice`."""
    here = F.lit("local_file")
    return (
        F.when(size_bytes.isNull(), unavailable_invoice(here, path, F.lit("file_not_found")))
        .when(_too_large(size_bytes, max_bytes), unavailable_invoice(here, path, F.lit(oversize(max_bytes or 0)), size_bytes))
        .when(
            F.coalesce(head, F.lit("")) != _PDF_MAGIC,
            unavailable_invoice(here, path, F.lit("not_a_pdf_magic_bytes_missing"), size_bytes, sha256),
        )
        .otherwise(pdf_invoice(here, path, text, page_count, hint, sha256, size_bytes, full_read, tokens))
    )


def is_readable(document: Column) -> Column:
    return F.coalesce(document["kind"].isin(*vocab.READABLE_KINDS), F.lit(False))


def without_text(document: Column) -> Column:
    """The document as rows carry it: sizes, hash and token counts; the text stays in `resolution.document_texts`."""
    return document.withField("text", F.lit(None).cast("string"))


def invoice_summary(document: Column) -> Column:
    """What a decision record keeps: no text, no estimate; null when no document was referenced."""
    kept = document.dropFields("text", "text_tokens", "est_input_tokens")
    return F.when(document["kind"].isin("pdf", "text", "error"), kept)


def downgrade_to_error(document: Column, reason: Column) -> Column:
    """Keep the identity of a document whose read failed later, drop everything readable."""
    return unavailable_invoice(
        F.coalesce(document["source"], F.lit("url")), F.coalesce(document["path_or_url"], F.lit("")), reason,
        document["size_bytes"], document["sha256"],
    )


def is_transient_status(code: Column) -> Column:
    """HTTP codes worth another try."""
    return code.isin(408, 429) | code.between(500, 599)


def is_share_url(url: Column) -> Column:
    """Sharing links that need a signed-in fetch."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(host.isin(*vocab.SHARE_HOSTS) | host.endswith(vocab.SHARE_HOST_SUFFIX), F.lit(False))


def share_id(url: Column) -> Column:
    """`u!` and the URL in unpadded URL-safe base64."""
    encoded = F.translate(F.base64(F.encode(url, "UTF-8")), "+/\r\n", "-_")
    return F.concat(F.lit("u!"), F.rtrim(encoded, F.lit("=")))
