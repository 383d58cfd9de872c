"""Cell cleaning, page logic, token and price arithmetic, document trust, text hygiene."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import vocab
from ...functions import cleaning, documents, mining, pages, reporting, tokens
from ..registry import part, query
from . import common  # noqa: F401

_CLEAN = "trim(replace({0}, '#NAME?', ''))"
_NULLED = "case when upper({0}) not in ('', 'NULL', '#NAME?') then {0} end"


@query("p1_clean_text", "raw_cells",
       check=f"select o_orderkey, {_NULLED.format(_CLEAN.format('raw_text'))} as cleaned from raw_cells")
def clean_text(ctx):
    return ctx.view("raw_cells").select("o_orderkey", cleaning.clean_text(F.col("raw_text")).alias("cleaned"))


_ID = "trim(case when id_type = 'n' then regexp_replace(raw_id, '^(-?[0-9]+)\\.0+$', '\\1') else raw_id end)"


@query("p2_clean_id", "raw_cells", check=f"select o_orderkey, {_NULLED.format(_ID)} as cleaned from raw_cells")
def clean_id(ctx):
    return ctx.view("raw_cells").select(
        "o_orderkey", cleaning.clean_id(F.col("raw_id"), F.col("id_type")).alias("cleaned")
    )


@query("p3_serial_to_iso", "raw_cells", check="""
select o_orderkey, case when o_orderkey % 90000 between 20000 and 80000
 then cast(date '1899-12-30' + cast(o_orderkey % 90000 as int) as varchar) end as iso,
 cast(date '1899-12-30' + cast(20000 + o_orderkey % 60000 as int) as varchar) as shifted from raw_cells""")
def serial(ctx):
    key = F.col("o_orderkey")
    return ctx.view("raw_cells").select(
        "o_orderkey", cleaning.serial_to_iso((key % 90000).cast("string")).alias("iso"),
        cleaning.serial_to_iso(F.concat((20000 + key % 60000).cast("string"), F.lit(".5"))).alias("shifted"),
    )


@query("p4_clean_date", "raw_cells", check="""
select o_orderkey, case date_type when 'd' then left(raw_date, 10)
 when 'n' then case when cast(raw_date as double) between 20000 and 80000 then cast(date '1899-12-30' + cast(raw_date as int) as varchar) else raw_date end
 else case when upper(trim(raw_date)) not in ('', 'NULL', '#NAME?') then trim(raw_date) end end as cleaned,
 case date_type when 'd' then left(raw_date, 10)
 when 'n' then case when cast(raw_date as double) between 20000 and 80000 then cast(date '1899-12-30' + cast(raw_date as int) as varchar) else raw_date end
 else raw_date end as verbatim
from raw_cells""")
def clean_date(ctx):
    value, kind = F.col("raw_date"), F.col("date_type")
    return ctx.view("raw_cells").select(
        "o_orderkey", cleaning.clean_date(value, kind).alias("cleaned"), cleaning.raw_date(value, kind).alias("verbatim")
    )


@query("p5_parse_amount", "raw_cells", check="""
select o_orderkey, coalesce(v, 0) as amount, v is null as was_blank from (
 select o_orderkey, case amount_type when 'n' then try_cast(raw_amount as double) when 's' then
  case when t[1] = '(' and t[-1] = ')' then -n else n end end as v
 from (select *, trim(raw_amount) as t,
   case when regexp_full_match(trim(replace(replace(trim(raw_amount, ' ()'), '$', ''), ',', '')),
    '[+-]?([0-9]+(_[0-9]+)*\\.?([0-9]+(_[0-9]+)*)?|\\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?')
        then try_cast(replace(trim(replace(replace(trim(raw_amount, ' ()'), '$', ''), ',', '')), '_', '') as double) end as n
  from raw_cells) a) b""")
def parse_amount(ctx):
    value, kind = F.col("raw_amount"), F.col("amount_type")
    return ctx.view("raw_cells").select(
        "o_orderkey", cleaning.parse_amount(value, kind).alias("amount"),
        cleaning.amount_was_blank(value, kind).alias("was_blank"),
    )


@query("p6_currency", "raw_cells", check=f"""
select o_orderkey, upper(coalesce({_NULLED.format(_CLEAN.format('raw_currency'))}, 'UNKNOWN')) as currency from raw_cells""")
def currency(ctx):
    return ctx.view("raw_cells").select("o_orderkey", cleaning.clean_currency(F.col("raw_currency")).alias("currency"))


@query("p7_normalize_key", "ledger", check="""
select row_idx, regexp_replace(regexp_replace(upper(concat('Inv #-', coalesce(descrptn, ref))), '^INV[\\s#\\-.:]*', ''), '[^A-Z0-9]', '', 'g') as k,
 regexp_replace(regexp_replace(upper(coalesce(adddesc, ref)), '^INV[\\s#\\-.:]*', ''), '[^A-Z0-9]', '', 'g') as k2 from ledger""")
def normalize(ctx):
    prefixed = F.concat(F.lit("Inv #-"), F.coalesce("descrptn", "ref"))
    return ctx.view("ledger").select(
        "row_idx", mining.normalize_key(prefixed).alias("k"),
        mining.normalize_key(F.coalesce("adddesc", "ref")).alias("k2"),
    )


@query("p8_prefixed_token", "text_tokens", check="select row_idx, descrptn_a as d, adddesc_a as a from text_tokens")
def prefixed_token(ctx):
    return ctx.view("ledger").select(
        "row_idx", mining.inv_prefix_token(F.col("descrptn")).alias("d"),
        mining.inv_prefix_token(F.col("adddesc")).alias("a"),
    )


@query("p9_leading_token", "text_tokens", check="select row_idx, descrptn_b as d, adddesc_b as a from text_tokens")
def leading(ctx):
    return ctx.view("ledger").select(
        "row_idx", mining.leading_token(F.col("descrptn")).alias("d"),
        mining.leading_token(F.col("adddesc")).alias("a"),
    )


@query("p10_standalone_word", "text_tokens", check="""
select row_idx, trim(descrptn_words[descrptn_at], '.,;:()[]"''') as d, trim(adddesc_words[adddesc_at], '.,;:()[]"''') as a from text_tokens""")
def standalone(ctx):
    return ctx.view("ledger").select(
        "row_idx", mining.standalone_word(F.col("descrptn"))["token"].alias("d"),
        mining.standalone_word(F.col("adddesc"))["token"].alias("a"),
    )


part("doc_words", ("documents",), """
select doc_id, unnest(string_split_regex(text, '\\s+')) as w from documents
""")


@query("p10_standalone_word_documents", check="""
select doc_id, trim(words[hit], '.,;:()[]"''') as token from (
 select doc_id, words, list_filter(range(1, len(words) + 1), lambda i: ok[i] and (coalesce(alpha[i - 1], false) and i > 1 or coalesce(alpha[i + 1], false)))[1] as hit from (
  select doc_id, words,
   list_transform(words, lambda w: regexp_full_match(trim(w, '.,;:()[]"'''), '[A-Za-z]{3,}')) as alpha,
   list_transform(words, lambda w: regexp_full_match(trim(w, '.,;:()[]"'''), '(?i)[A-Z0-9][A-Z0-9\\-/]{4,}')
     and regexp_matches(w, '[0-9]') and not regexp_full_match(trim(w, '.,;:()[]"'''), '[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}')) as ok
  from (select doc_id, list_filter(string_split_regex(text, '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'), lambda w: w <> '') as words from documents) a) b) c""")
def standalone_documents(ctx):
    return ctx.view("documents").select("doc_id", mining.standalone_word(F.col("text"))["token"].alias("token"))


@query("p11_rejected_token", "ledger", check="""
select row_idx, tok, regexp_full_match(tok, '[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}') or not regexp_matches(tok, '[0-9]') as rejected
from (select row_idx, unnest(string_split(coalesce(descrptn, entrdate), ' ')) as tok from ledger)""")
def rejected(ctx):
    words = ctx.view("ledger").select(
        "row_idx", F.explode(F.split(F.coalesce("descrptn", "entrdate"), " ")).alias("tok")
    )
    return words.withColumn("rejected", mining.is_rejected_token(F.col("tok")))


@query("p12_truncated_key", "mined", check="select row_idx, truncated from mined where length(descrptn) >= 40")
def truncated(ctx):
    mined = mining.mine_invoice_key(F.col("descrptn"), F.col("adddesc"))
    return ctx.view("ledger").where(F.length("descrptn") >= 40).select("row_idx", mined["truncated"].alias("truncated"))


@query("p14_substantive_reference", "mined", check="""
select row_idx, length(regexp_replace(invoice_url, '[^\\p{L}\\p{N}]', '', 'g')) >= 4 as url_ok,
 length(regexp_replace(ref, '[^\\p{L}\\p{N}]', '', 'g')) >= 4 as ref_ok from mined""")
def substantive(ctx):
    return ctx.view("ledger").select(
        "row_idx", mining.is_substantive_reference(F.col("invoice_url")).alias("url_ok"),
        mining.is_substantive_reference(F.col("ref")).alias("ref_ok"),
    )


# -- tokens ------------------------------------------------------------------------------------------------------

_TEXT_FIELDS = (
    "period", "acctnum", "ref", "entityid", "department", "category", "currency", "descrptn", "adddesc", "source",
    "entrdate", "userid", "invoice_url",
)
JSON_TEXT = (
    "case when {0} is null then 4 else 2 + length({0}) + length({0}) - length(regexp_replace({0}, '[\"\\\\\\n\\r\\t\\x08\\f]', '', 'g'))"
    " + 5 * length(regexp_replace({0}, '[^\\x{{80}}-\\x{{10FFFF}}]', '', 'g')) + 6 * length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) end"
)
_AMOUNT_TEXT = "regexp_replace(regexp_replace(cast(cast(amount as decimal(38,6)) as varchar), '0+$', ''), '\\.$', '.0')"
_NAMES = ("row_idx", "amount", "amount_was_blank", *_TEXT_FIELDS)
ROW_TOKENS = (
    f"cast(floor(({sum(len(n) for n in _NAMES)} + 6 * {len(_NAMES)} + length(cast(row_idx as varchar)) + length({_AMOUNT_TEXT})"
    " + case when amount_was_blank then 4 else 5 end + "
    + " + ".join(JSON_TEXT.format(f) for f in _TEXT_FIELDS)
    + ") / 4) as bigint) + 860"
)


@query("p19_row_tokens", "ledger", check=f"select row_idx, {ROW_TOKENS} as est_tokens from ledger")
def row_tokens(ctx):
    return ctx.view("ledger").select("row_idx", tokens.estimate_row_tokens().alias("est_tokens"))


@query("p19_json_text_length", check=f"select doc_id, {JSON_TEXT.format('text')} as n from documents")
def json_length(ctx):
    return ctx.view("documents").select("doc_id", tokens.json_text_length(F.col("text")).alias("n"))


_PRICE = (
    "case when model like '%claude-opus-4-8%' or model like '%claude-opus-4-7%' or model like '%claude-opus-4-6%' then {0} "
    "when model like '%claude-haiku-4-5%' then {1} else {2} end"
)


@query("p30_prices", "decision_log", check=f"""
select seq, {_PRICE.format('5.0', '1.0', '3.0')}::double as input_price, {_PRICE.format('25.0', '5.0', '15.0')}::double as output_price,
 cast(input_tokens * {_PRICE.format('5', '1', '3')} + output_tokens * {_PRICE.format('25', '5', '15')} as double) as cost_micros
from decision_log""")
def prices(ctx):
    model = F.col("model")
    cost = tokens.cost_micros(model, F.col("input_tokens"), F.col("output_tokens"))
    return ctx.view("decision_log").select(
        "seq", tokens.input_price(model).alias("input_price"), tokens.output_price(model).alias("output_price"),
        cost.cast("double").alias("cost_micros"),
    )


# -- pages -------------------------------------------------------------------------------------------------------

_HINTS = (
    "case o_orderkey % 8 when 0 then null when 1 then concat(cast(o_orderkey % 20 as varchar(5)), '-', cast(o_orderkey % 31 as varchar(5))) "
    "when 2 then '3-8' when 3 then 'all' when 4 then ' 2 - 40 ' when 5 then '60-70' when 6 then '7' else '0-12' end"
)
part("page_cases", ("orders",), f"select o_orderkey, cast(1 + o_orderkey % 45 as int) as page_count, {_HINTS} as hint from orders")
part("page_windows", ("page_cases",), """
select o_orderkey, case when ok then greatest(1, a) else 1 end as lo, case when ok then least(b, page_count) else page_count end as hi
from (select *, a is not null and b is not null and greatest(1, a) <= page_count and greatest(1, a) <= least(b, page_count) as ok from (
 select *, try_cast(trim(split_part(hint, '-', 1)) as int) as a, try_cast(trim(nullif(split_part(hint, '-', 2), '')) as int) as b from page_cases) s) t
""")
part("page_choice", ("page_windows",), """
select o_orderkey, case when hi - lo + 1 <= 20 then range(lo, hi + 1) else list_value(lo, lo + 1, hi - 1, hi) end as pages,
 case when hi - lo + 1 <= 20 then concat(cast(lo as varchar), '-', cast(hi as varchar))
  else concat(cast(lo as varchar), '-', cast(lo + 1 as varchar), ',', cast(hi - 1 as varchar), '-', cast(hi as varchar)) end as pages_read
from page_windows
""")


def _page_cases(ctx):
    hint = F.expr(_HINTS)
    return ctx.view("orders").select(
        "o_orderkey", (1 + F.col("o_orderkey") % 45).cast("int").alias("page_count"), hint.alias("hint")
    )


@query("p22_select_pages", "page_choice", check="""
select o_orderkey, array_to_string(pages, ',') as pages, pages_read from page_choice""")
def select_pages(ctx):
    chosen = pages.select_pages(F.col("page_count"), F.col("hint"))
    return _page_cases(ctx).select(
        "o_orderkey", F.array_join(chosen.cast("array<string>"), ",").alias("pages"),
        pages.format_pages(chosen).alias("pages_read"),
    )


@query("p23_pages_read", "page_choice", check="""
select o_orderkey, case o_orderkey % 6 when 4 then null when 5 then null else len(pages) end as n,
 case o_orderkey % 6 when 5 then false when 4 then false else pages[-1] - pages[1] + 1 > len(pages) end as truncated from page_choice""")
def pages_read(ctx):
    text = F.when(F.col("o_orderkey") % 6 == 4, "x-y").when(
        F.col("o_orderkey") % 6 != 5, pages.format_pages(pages.select_pages(F.col("page_count"), F.col("hint")))
    )
    return _page_cases(ctx).withColumn("r", text).select(
        "o_orderkey", pages.pages_read_count(F.col("r")).alias("n"), pages.has_gap(F.col("r")).alias("truncated")
    )


# -- documents ---------------------------------------------------------------------------------------------------

_MARKERS = " or ".join(f"contains(lower(body), '{m}')" for m in vocab.LOGIN_MARKERS)
_SHOWN = ("kind", "source", "path_or_url", "pages_read", "page_count", "sha256", "size_bytes", "read_path", "est_input_tokens", "error")
part("bodies", ("fetched_bodies",), f"""
select url, kind, 'url' as source, url as path_or_url,
 case when kind = 'pdf' then case when page_count <= 20 then concat('1-', cast(page_count as varchar))
   else concat('1-2,', cast(page_count - 1 as varchar), '-', cast(page_count as varchar)) end end as pages_read,
 case when kind = 'pdf' then page_count end as page_count,
 case when error is null or error not like 'oversize%' then sha256(body) end as sha256,
 strlen(body) as size_bytes, case kind when 'pdf' then 'vision' when 'text' then 'text' end as read_path,
 case kind when 'pdf' then case when page_count <= 20 then page_count else 4 end * 5300 + length(body) // 4 when 'text' then length(body) // 4 else 0 end as est_input_tokens,
 error, case when kind <> 'error' then body end as text
from (select *, case when error is not null then 'error' when contains(content_type, 'pdf') or starts_with(body, '%PDF-') then 'pdf' else 'text' end as kind
 from (select *, case when strlen(body) > 20971520 then 'oversize_>20971520_bytes'
  when contains(content_type, 'pdf') or starts_with(body, '%PDF-') then null
  when contains(content_type, 'html') then 'html_response_possible_login_or_expired_url'
  when contains(content_type, 'json') or starts_with(content_type, 'text/') then case when {_MARKERS} then 'login_page_detected' end
  else concat('unsupported_content_type: ', content_type) end as error from fetched_bodies) a) b
""")
part("files", ("invoice_files",), """
select stem, case when size_bytes > 20971520 or head <> '%PDF-' then 'error' else 'pdf' end as kind, page_count, sha256, size_bytes, text,
 case when size_bytes > 20971520 then 'oversize_>20971520_bytes' when head <> '%PDF-' then 'not_a_pdf_magic_bytes_missing' end as error
from invoice_files
""")


def bodies(ctx):
    document = documents.classify_body(F.col("url"), F.col("content_type"), F.col("body"), F.col("page_count"))
    return ctx.view("fetched_bodies").select("url", document.alias("doc"))


@query("p24_body_trust", "bodies",
       check=f"select url, {', '.join(_SHOWN)}, length(text) as text_length from bodies")
def body_trust(ctx):
    return bodies(ctx).select(
        "url", *[F.col(f"doc.{name}") for name in _SHOWN], F.length("doc.text").alias("text_length")
    )


@query("p25_file_trust", "files", check="""
select stem, kind, error, case when error is null or error not like 'oversize%' then sha256 end as sha256, size_bytes,
 case when kind = 'pdf' then case when page_count <= 20 then concat('1-', cast(page_count as varchar))
  else concat('1-2,', cast(page_count - 1 as varchar), '-', cast(page_count as varchar)) end end as pages_read from files""")
def file_trust(ctx):
    document = documents.classify_file(
        F.col("stem"), F.col("size_bytes"), F.col("head"), F.col("sha256"), F.col("page_count"), F.col("text"),
        F.lit(None).cast("string"),
    )
    return ctx.view("invoice_files").select("stem", document.alias("doc")).select(
        "stem", "doc.kind", "doc.error", "doc.sha256", "doc.size_bytes", "doc.pages_read"
    )


@query("p26_transient_status", check="""
select event_id, (200 + event_id % 400) in (408, 429) or (200 + event_id % 400) between 500 and 599 as retry from events""")
def transient(ctx):
    return ctx.view("events").select(
        "event_id", documents.is_transient_status(200 + F.col("event_id") % 400).alias("retry")
    )


@query("p27_invoice_summary", "bodies", check="""
select url, kind, error, sha256, 'error' as down_kind, 'vision_failed' as down_error, sha256 as down_sha, size_bytes as down_size, 0 as down_tokens
from bodies""")
def summary(ctx):
    down = documents.downgrade_to_error(F.col("doc"), F.lit("vision_failed"))
    return bodies(ctx).select(
        "url", documents.invoice_summary(F.col("doc")).alias("s"), down.alias("d")
    ).select(
        "url", "s.kind", "s.error", "s.sha256", F.col("d.kind").alias("down_kind"), F.col("d.error").alias("down_error"),
        F.col("d.sha256").alias("down_sha"), F.col("d.size_bytes").alias("down_size"),
        F.col("d.est_input_tokens").alias("down_tokens"),
    )


_SHARE = "case page_id % 4 when 0 then concat('https://1drv.ms/', cast(page_id as varchar(9))) when 1 then concat('https://acme.sharepoint.com/s/', cast(page_id as varchar(9))) else url end"


@query("p28_share_links", check=f"""
select page_id, page_id % 4 < 2 as is_share, concat('u!', rtrim(replace(replace(base64(encode({_SHARE})), '+', '-'), '/', '_'), '=')) as share_id from pages""")
def share_links(ctx):
    return ctx.view("pages").select("page_id", F.expr(_SHARE).alias("u")).select(
        "page_id", documents.is_share_url(F.col("u")).alias("is_share"), documents.share_id(F.col("u")).alias("share_id")
    )


# -- fingerprint and report text ---------------------------------------------------------------------------------

_HASHED = ("acctnum", "adddesc", "amount", "category", "currency", "department", "descrptn", "entityid", "entrdate",
           "invoice_url", "period", "ref", "source", "userid")


def fingerprint_sql(sha: str) -> str:
    value = lambda n: "cast(cast(amount as decimal(38,2)) as varchar)" if n == "amount" else n
    tagged = ", ".join(f"case when {n} is null then '{n}!' else concat('{n}=', {value(n)}) end" for n in _HASHED)
    return f"sha256(concat_ws(chr(31), {tagged}, coalesce({sha}, 'no_invoice'), 'v4'))"


@query("p29_fingerprint", "ledger", check=f"""
select row_idx, {fingerprint_sql('null')} as plain, {fingerprint_sql('ref')} as with_document from ledger""")
def fingerprint(ctx):
    return ctx.view("ledger").select(
        "row_idx", reporting.row_fingerprint(F.lit(None).cast("string")).alias("plain"),
        reporting.row_fingerprint(F.col("ref")).alias("with_document"),
    )


_POINTER = (
    "case o_orderkey % 7 when 0 then null when 1 then concat('http://x/', cast(o_orderkey as varchar(12))) when 2 then cast(o_orderkey as varchar(12)) "
    "when 3 then ' Unpaid ' when 4 then '12.75' else o_orderpriority end"
)


@query("p34_supporting_doc", check=f"""
select o_orderkey, case when p is null then case when o_orderstatus = 'O' then 'No invoice on file' else 'Invoice on file — no reference' end
 when starts_with(p, 'http') then 'View Invoice' when try_cast(p as double) is not null then concat('Page ', cast(cast(trunc(try_cast(p as double)) as bigint) as varchar), ' (batch PDF)')
 when lower(trim(p)) = 'unpaid' then 'Unpaid — no invoice ref' else p end as shown,
 case when p is null then 'none' when starts_with(p, 'http') then 'url' when try_cast(p as double) is not null then 'number' else 'text' end as kind
from (select o_orderkey, o_orderstatus, {_POINTER} as p from orders)""")
def supporting(ctx):
    had = F.when(F.col("o_orderstatus") == "O", "no").otherwise("yes")
    return ctx.view("orders").select("o_orderkey", had.alias("had"), F.expr(_POINTER).alias("p")).select(
        "o_orderkey", reporting.supporting_doc(F.col("p"), F.col("had")).alias("shown"),
        reporting.supporting_doc_kind(F.col("p")).alias("kind"),
    )


@query("p35_review_text", "ledger", check="""
select row_idx, case when currency <> 'USD' then concat(currency, ' ', format('{:,.2f}', cast(amount as decimal(18,2)))) else '—' end as local_amount,
 cast(try_cast(entrdate as date) as varchar) as entry_date,
 case row_idx % 4 when 0 then 'Human Review' when 1 then 'Non-Recurring' when 2 then 'Needs Reclass (raw: "L")' else 'other' end as label,
 coalesce(nullif(adddesc, ''), '—') as additional from ledger""")
def review_text(ctx):
    word = F.element_at(F.array(*map(F.lit, ("human_review", "non_recurring", "L", "other"))), (F.col("row_idx") % 4 + 1).cast("int"))
    return ctx.view("ledger").select(
        "row_idx", reporting.local_amount(F.col("currency"), F.col("amount")).alias("local_amount"),
        F.col("entrdate").try_cast("date").cast("string").alias("entry_date"), reporting.class_label(word).alias("label"),
        reporting.dash_if_empty(F.col("adddesc")).alias("additional"),
    )


@query("p36_quarter_span", "ledger", check="""
select currency, case when min(q) = max(q) then min(q) else concat(min(q), ' – ', max(q)) end as span from (
 select currency, concat(left(period, 4), 'Q', cast((cast(right(period, 2) as int) + 2) // 3 as varchar)) as q from ledger) t group by currency""")
def quarter_span(ctx):
    from ...functions.periods import quarter_of

    return ctx.view("ledger").groupBy("currency").agg(
        F.min(quarter_of(F.col("period"))).alias("low"), F.max(quarter_of(F.col("period"))).alias("high")
    ).select("currency", reporting.quarter_span(F.col("low"), F.col("high")).alias("span"))


_COMMENTED = "concat('<!-- note ', lang, chr(10), ' --> ', text, '<!-- end -->')"


@query("p37_text_hygiene", check="""
select doc_id, words, length(body) as chars, case when words = 0 then 'empty' when words > 2500 then 'too_large' when words > 1250 then 'warn' else 'ok' end as status
from (select doc_id, body, len(list_filter(string_split_regex(body, '\\s+'), lambda w: w <> '')) as words
 from (select doc_id, trim(regexp_replace(concat('<!-- note ', lang, chr(10), ' --> ', text, '<!-- end -->'), '(?s)<!--.*?-->', '', 'g'), E' \\t\\n\\r') as body from documents))""")
def hygiene(ctx):
    body = reporting.strip_comments(F.expr(_COMMENTED))
    words = reporting.word_count(F.col("body"))
    return ctx.view("documents").select("doc_id", body.alias("body")).withColumn("words", words).select(
        "doc_id", "words", F.length("body").alias("chars"), reporting.context_status(F.col("words")).alias("status")
    )


@query("p38_scorer_view")
def scorer_view(ctx):
    from ...operators.reconcile import scorer_view as shown

    return shown(ctx.view("ledger"))
