"""Cell grids: `cells(file, sheet_no, sheet, row_no, col_no, value, vtype)`, one row per filled cell, both 1-based.

Whatever decodes a workbook writes this table; rows, columns and typed ledgers are made from it here. Column positions
are worked out per sheet with plain aggregates over header cells, so no dictionary is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import cleaning
from ..operators.joins import counted_side, lookup_join
from ..session import materialize

SHEET = ["file", "sheet"]
CELL_TYPE = "struct<value:string,vtype:string>"


def rows_from_cells(cells: DataFrame) -> DataFrame:
    """`cells` as one map per row: column number to value and type. A row has at most 16 384 columns.

    The row comes first among the keys: they are sorted, and a sheet's cells differ in nothing before it.
    """
    cell = F.struct("value", "vtype").cast(CELL_TYPE)
    return cells.groupBy("row_no", "sheet", "file").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("col_no"), cell))).alias("cells")
    ).select("file", "sheet", "row_no", "cells")


def _of_sheets(facts: DataFrame, label: str) -> DataFrame:
    """A table of one row per sheet, written and broadcast if they are few enough: cells then need not meet by sheet."""
    return counted_side(materialize(facts, label))


#: Rows of a sheet that share an entry of a table of chosen rows, a bit each.
_ROWS = 64


def cells_of_rows(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """The cells of `rows` (file, sheet, row_no), which are found without a shuffle while an entry for each 64 rows fits a broadcast."""
    group, bit = F.expr(f"row_no div {_ROWS}"), F.expr(f"shiftleft(1L, cast(row_no % {_ROWS} as int))")
    marks = rows.groupBy(*SHEET, group.alias("_group")).agg(F.bit_or(bit).alias("_rows"))
    marked = cells.withColumn("_group", group).join(counted_side(materialize(marks, "chosen-rows")), [*SHEET, "_group"])
    return marked.where(F.col("_rows").bitwiseAND(bit) != 0).select(*cells.columns)


def _header(c: str = "value") -> Column:
    return F.lower(cleaning.strip(F.col(c)))


def _first_alias(header: Column, aliases: tuple[str, ...]) -> Column:
    """Place in the alias list of the first alias the header contains."""
    chosen = None
    for place, alias in enumerate(aliases):
        test = header.contains(alias)
        chosen = F.when(test, place) if chosen is None else chosen.when(test, place)
    return chosen


def field_columns(headers: DataFrame, spec: dict[str, tuple[str, ...]], by: list[str] = SHEET) -> DataFrame:
    """Per sheet and field: the first column holding the highest-priority alias that occurs at all; null if none.

    `headers` are the cells of the header row.
    """
    header = _header()
    best = []
    for field, aliases in spec.items():
        place = _first_alias(header, aliases)
        best.append(F.min(F.when(place.isNotNull(), F.struct(place.alias("place"), F.col("col_no"), header.alias("header")))).alias(field))
    named = F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"{f}.col_no").alias("col_no"), F.col(f"{f}.header").alias("header")) for f in spec
    ])
    return headers.groupBy(*by).agg(*best).select(*by, F.explode(named).alias("f")).select(*by, "f.*")


def resolve_columns(headers: DataFrame) -> DataFrame:
    """Ledger fields to columns; `fallback` marks fields no header named, which take their usual position."""
    spec = {f: aliases for f, (aliases, _) in vocab.LEDGER_COLUMNS.items()}
    usual = F.create_map(*[x for f, (_, at) in vocab.LEDGER_COLUMNS.items() for x in (F.lit(f), F.lit(at))])
    return field_columns(headers, spec).select(
        "file", "sheet", "field", F.coalesce("col_no", usual[F.col("field")]).alias("col_no"), "header",
        F.col("col_no").isNull().alias("fallback"),
    )


def first_row(cells: DataFrame) -> DataFrame:
    return cells.where("row_no = 1")


def column_warnings(headers: DataFrame) -> DataFrame:
    """Unresolved fields, columns serving several fields, and an amount column that is not the USD one."""
    resolved = resolve_columns(headers)
    texts = headers.select("file", "sheet", "col_no", _header().alias("at_column"))
    unresolved = resolved.where("fallback").select(
        "file", "sheet", F.lit("unresolved").alias("kind"), F.col("field").alias("fields"), "col_no"
    )
    # At most fourteen fields per sheet.
    shared = resolved.groupBy("file", "sheet", "col_no").agg(F.array_sort(F.collect_list("field")).alias("f")).where(
        F.size("f") > 1
    ).select("file", "sheet", F.lit("shared").alias("kind"), F.array_join("f", ",").alias("fields"), "col_no")
    amount = resolved.where("field = 'amount'").join(texts, ["file", "sheet", "col_no"], "left").where(
        F.coalesce("at_column", F.lit("")) != vocab.AMOUNT_HEADER
    ).select("file", "sheet", F.lit("amount").alias("kind"), F.lit("amount").alias("fields"), "col_no")
    return unresolved.unionByName(shared).unionByName(amount)


def choose_sheets(cells: DataFrame, preferred: str | None = None) -> DataFrame:
    """Per file the sheet that lacks the fewest ledger columns; then the preferred name; then the first.

    A sheet without a header row lacks every column.
    """
    sheets = cells.groupBy("file", "sheet").agg(F.min("sheet_no").alias("sheet_no"))
    lacking = resolve_columns(first_row(cells)).groupBy("file", "sheet").agg(F.count_if("fallback").alias("missing"))
    wanted = F.lit((preferred or "").strip().lower())
    other = ~((wanted != "") & (F.lower(cleaning.strip(F.col("sheet"))) == wanted))
    ranked = sheets.join(lacking, SHEET, "left").withColumn(
        "rank", F.struct(F.coalesce("missing", F.lit(len(vocab.LEDGER_COLUMNS))).alias("missing"), other.alias("other"), "sheet_no")
    )
    return ranked.groupBy("file").agg(F.min_by("sheet", "rank").alias("sheet"), F.min("rank.missing").alias("missing"))


def _positions(resolved: DataFrame, by: list[str] = SHEET) -> DataFrame:
    """One map per sheet: field to column. A sheet has as many entries as the field list."""
    found = resolved.where("col_no is not null")
    return found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("field", "col_no"))).alias("at"))


def _cell(field: str) -> Column:
    return F.try_element_at("cells", F.try_element_at("at", F.lit(field)))


def read_ledger(cells: DataFrame, preferred: str | None = None) -> DataFrame:
    """Typed ledger rows of each file's data sheet. `row_idx` is the sheet row; blank rows have no cells and so no row."""
    chosen = _of_sheets(choose_sheets(cells, preferred).select("file", "sheet"), "data-sheets")
    headers = first_row(cells).join(chosen, SHEET, "left_semi")
    at = _of_sheets(_positions(resolve_columns(headers)), "data-columns")
    body = rows_from_cells(cells.where("row_no > 1 and value is not null"))
    located = lookup_join(body, at, SHEET, "row_no", how="inner")
    value = {f: _cell(f)["value"] for f in vocab.LEDGER_COLUMNS}
    kind = {f: F.coalesce(_cell(f)["vtype"], F.lit("s")) for f in vocab.LEDGER_COLUMNS}
    text = lambda f: cleaning.clean_text(value[f])
    ident = lambda f: cleaning.clean_id(value[f], kind[f])
    or_empty = lambda c: F.coalesce(c, F.lit(""))
    return located.select(
        "file", F.col("row_no").cast("bigint").alias("row_idx"), or_empty(ident("period")).alias("period"),
        or_empty(text("acctnum")).alias("acctnum"), or_empty(ident("ref")).alias("ref"),
        or_empty(ident("entityid")).alias("entityid"), text("department").alias("department"), text("category").alias("category"),
        cleaning.parse_amount(value["amount"], kind["amount"]).alias("amount"),
        cleaning.amount_was_blank(value["amount"], kind["amount"]).alias("amount_was_blank"),
        cleaning.clean_currency(value["currency"]).alias("currency"), text("descrptn").alias("descrptn"),
        text("adddesc").alias("adddesc"), or_empty(text("source")).alias("source"),
        cleaning.clean_date(value["entrdate"], kind["entrdate"]).alias("entrdate"), text("userid").alias("userid"),
        text("invoice_url").alias("invoice_url"),
    )


def blank_rows(cells: DataFrame, preferred: str | None = None) -> DataFrame:
    """Rows below the header without any value, per file's data sheet."""
    chosen = choose_sheets(cells, preferred).select("file", "sheet")
    filled = F.when(F.col("value").isNotNull() & (F.col("row_no") > 1), F.col("row_no"))
    counted = cells.join(chosen, SHEET, "left_semi").groupBy("file", "row_no").agg(F.max(filled).alias("filled"))
    return counted.groupBy("file").agg(
        (F.max("row_no") - 1 - F.count("filled")).cast("bigint").alias("skipped_blank_rows")
    )


def raw_rows(cells: DataFrame, file: str, sheet: str) -> DataFrame:
    """The sheet verbatim: named columns up to the first blank header, every row, dates of date columns as ISO text.

    Only the header row of this one sheet comes to the driver.
    """
    grid = cells.where((F.col("file") == file) & (F.col("sheet") == sheet))
    named = {r.col_no: r.value.strip() for r in first_row(grid).select("col_no", "value").collect() if r.value and r.value.strip()}
    headers = []
    while len(headers) + 1 in named:
        headers.append(named[len(headers) + 1])
    last = grid.agg(F.max("row_no")).first()[0] or 1
    numbers = grid.sparkSession.range(2, last + 1).select(F.col("id").cast("int").alias("row_no"))
    kept = grid.where((F.col("row_no") > 1) & (F.col("col_no") <= len(headers)))
    body = numbers.join(rows_from_cells(kept).drop("file", "sheet"), "row_no", "left")

    def column(at: int, header: str) -> Column:
        cell = F.try_element_at("cells", F.lit(at))
        value = cleaning.raw_date(cell["value"], cell["vtype"]) if "date" in header.lower() else cell["value"]
        return value.alias(header)

    return body.select("row_no", *[column(i, h) for i, h in enumerate(headers, start=1)])


# -- account tabs and the flat sheet -----------------------------------------------------------------------------


def header_rows(cells: DataFrame, probe_rows: int = vocab.PROBE_ROWS) -> DataFrame:
    """Per sheet the first of the top `probe_rows` that names period, counterparty and amount; else the usual row, flagged."""
    header = _header()
    seen = [F.bool_or(header.contains(word)).alias(word) for word in vocab.PROBE_WORDS]
    top = cells.where(F.col("row_no") <= probe_rows)
    probed = top.groupBy("file", "sheet", "row_no").agg(*seen)
    every = F.lit(True)
    for word in vocab.PROBE_WORDS:
        every = every & F.col(word)
    found = probed.groupBy("file", "sheet").agg(F.min(F.when(every, F.col("row_no"))).alias("found"))
    sheets = cells.select("file", "sheet").distinct()
    return sheets.join(found, SHEET, "left").select(
        "file", "sheet", F.coalesce("found", F.lit(vocab.PROBE_FALLBACK_ROW)).alias("header_row"),
        F.col("found").isNull().alias("fallback"),
    )


def tab_columns(cells: DataFrame, probe_rows: int = vocab.PROBE_ROWS) -> DataFrame:
    """Per account tab: field to column, from its header row; fields without a column are left out."""
    top = cells.where(F.col("row_no") <= probe_rows)
    headers = top.join(header_rows(cells, probe_rows), SHEET).where("row_no = header_row")
    return field_columns(headers, vocab.TAB_COLUMNS).where("col_no is not null").select("file", "sheet", "field", "col_no")


def account_tabs(cells: DataFrame, probe_rows: int = vocab.PROBE_ROWS) -> DataFrame:
    """Every sheet with account id (A2), name (A1, else the tab's), header row, last row, and why it is skipped."""
    corner = lambda r: F.max(F.when(F.col("row_no") == r, F.struct("value", "vtype")))
    corners = cells.where("col_no = 1 and row_no <= 2").groupBy(*SHEET).agg(corner(1).alias("a1"), corner(2).alias("a2"))
    # Apart from the corners, so that numbers alone are folded over all cells.
    tabs = cells.groupBy(*SHEET).agg(F.max("row_no").alias("last_row")).join(corners, SHEET, "left")
    ident = cleaning.none_if_blank(cleaning.strip(cleaning.whole_number_text(F.col("a2.value"), F.col("a2.vtype"))))
    name = cleaning.none_if_blank(cleaning.strip(F.col("a1.value")))
    reason = F.when(F.col("last_row") < 2, "fewer than 2 rows").when(
        ~F.coalesce(ident.rlike(vocab.ACCOUNT_ID_PATTERN), F.lit(False)), "A2 is not an account"
    )
    return tabs.select(
        "file", "sheet", ident.alias("account"), F.coalesce(name, F.col("sheet")).alias("account_name"), "last_row",
        reason.alias("skip_reason"),
    ).join(header_rows(cells, probe_rows), SHEET)


def _tab_rows(cells: DataFrame, probe_rows: int = vocab.PROBE_ROWS) -> DataFrame:
    tabs = account_tabs(cells, probe_rows).where("skip_reason is null").join(_positions(tab_columns(cells, probe_rows)), SHEET, "left")
    return lookup_join(rows_from_cells(cells), _of_sheets(tabs, "tabs"), SHEET, "row_no", how="inner").where("row_no > header_row")


def _tab_period() -> Column:
    return cleaning.none_if_blank(cleaning.strip(cleaning.whole_number_text(_cell("period")["value"], _cell("period")["vtype"])))


def extract_tabs(cells: DataFrame, probe_rows: int = vocab.PROBE_ROWS) -> DataFrame:
    """Rows of all account tabs in the flat column order; rows without a period are dropped."""
    text = lambda f: F.coalesce(_cell(f)["value"], F.lit(""))
    given = {
        "PERIOD": _tab_period(), "ACCTNUM": F.col("account"), "AMT": text("amount"), "DESCRPN": text("descrptn"),
        "ENTRDATE": text("date"), "OCURRCODE": F.lit("USD"), "ADDLDESC": text("adddesc"), "USERID": text("userid"),
        "Category": F.col("account_name"), "Quarter": text("quarter"), "Image URL - Hyperlink": text("invoice_link"),
        "Exchange Rate": F.lit("1"), "USD Amount": text("amount"), "Source Tab": F.col("account_name"),
    }
    kinds = F.struct(
        F.coalesce(_cell("amount")["vtype"], F.lit("s")).alias("amount"), F.coalesce(_cell("date")["vtype"], F.lit("s")).alias("date")
    )
    return _tab_rows(cells, probe_rows).where(_tab_period().isNotNull()).select(
        "sheet", "row_no", *[given.get(c, F.lit("")).alias(c) for c in vocab.FLAT_COLUMNS], kinds.alias("kinds")
    )


def tab_stats(cells: DataFrame, probe_rows: int = vocab.PROBE_ROWS) -> DataFrame:
    """Per tab: rows written, rows dropped for a blank period (also rows without any cell), skip reason."""
    written = _tab_rows(cells, probe_rows).groupBy("file", "sheet").agg(F.count_if(_tab_period().isNotNull()).alias("rows_written"))
    joined = account_tabs(cells, probe_rows).join(written, SHEET, "left").withColumn("rows_written", F.coalesce("rows_written", F.lit(0)))
    used = F.col("skip_reason").isNull()
    below = F.greatest(F.col("last_row") - F.col("header_row"), F.lit(0))
    return joined.select(
        "sheet", F.when(used, F.col("account")).alias("account"), F.when(used, F.col("rows_written")).alias("rows_written"),
        F.when(used, below - F.col("rows_written")).cast("bigint").alias("blank_period_dropped"), "skip_reason",
    )


def flat_sheet(cells: DataFrame) -> DataFrame:
    """Per file the A&T sheet: by name, else the first whose header row has a USD amount column."""
    header = _header()
    usd = F.bool_or((F.col("row_no") == 1) & (header == vocab.AMOUNT_HEADER))
    sheets = cells.groupBy("file", "sheet").agg(F.min("sheet_no").alias("sheet_no"), usd.alias("usd"))
    named = F.lower(cleaning.strip(F.col("sheet"))) == vocab.AT_SHEET.lower()
    fit = sheets.where(named | F.col("usd")).withColumn("rank", F.struct((~named).alias("other"), "sheet_no"))
    return fit.groupBy("file").agg(F.min_by("sheet", "rank").alias("sheet"))


def extract_flat(cells: DataFrame) -> DataFrame:
    """The M&A rows of the A&T sheet in the flat column order; the first column of each exact header counts."""
    columns = [c for c in vocab.FLAT_COLUMNS if c != "Source Tab"]
    chosen = _of_sheets(flat_sheet(cells), "flat-sheets")
    headers = first_row(cells).join(chosen, SHEET, "left_semi").select("file", "sheet", _header().alias("field"), "col_no").where("field <> ''")
    wanted = headers.where(F.col("field").isin([c.lower() for c in columns]))
    at = _of_sheets(_positions(wanted.groupBy("file", "sheet", "field").agg(F.min("col_no").alias("col_no"))), "flat-columns")
    filled = cells.where("row_no > 1 and value is not null")
    # Only rows of the account are put together from their cells.
    ident = cleaning.strip(cleaning.whole_number_text(F.col("value"), F.col("vtype")))
    is_ma = (ident == vocab.MA_ACCOUNT) | (ident.rlike("^[0-9]+$") & (F.concat(F.lit("MR"), ident) == vocab.MA_ACCOUNT))
    # One condition, which so stays above the join: the patterns are for account cells alone.
    named = F.col("col_no") == F.try_element_at("at", F.lit("acctnum"))
    account = F.try_element_at("at", F.lit("acctnum")).alias("col_no")
    held = [r.col_no for r in at.select(account).where("col_no is not null").distinct().collect()]  # 16 384 at most
    accounts = filled.where(F.col("col_no").isin(held)).join(at, SHEET).where(F.when(named, is_ma).otherwise(False))
    located = lookup_join(rows_from_cells(cells_of_rows(filled, accounts)), at, SHEET, "row_no", how="inner")
    kinds = F.struct(
        F.coalesce(_cell("usd amount")["vtype"], F.lit("s")).alias("amount"),
        F.coalesce(_cell("entrdate")["vtype"], F.lit("s")).alias("date"),
    )
    value = lambda c: F.coalesce(_cell(c.lower())["value"], F.lit("")).alias(c)
    return located.select(
        "sheet", "row_no", *[value(c) for c in columns], F.lit(vocab.AT_TAB).alias("Source Tab"), kinds.alias("kinds")
    )


def flatten(account_cells: DataFrame, flat_cells: DataFrame, probe_rows: int = vocab.PROBE_ROWS) -> DataFrame:
    """Account tabs and the A&T sheet as one flat table, `Source Tab` last."""
    return extract_tabs(account_cells, probe_rows).unionByName(extract_flat(flat_cells))


def flat_export(flat: DataFrame) -> DataFrame:
    """Exactly the 21 columns."""
    return flat.select(*vocab.FLAT_COLUMNS)


def ledger_from_flat(flat: DataFrame, row_idx: Column) -> DataFrame:
    """The typed ledger of a flat table, without writing it out first.

    `row_idx` numbers the rows; `kinds` tells how amounts and dates were typed in their cells.
    """
    ident = lambda c: F.coalesce(cleaning.clean_id(F.col(f"`{c}`"), "n"), F.lit(""))
    text = lambda c: cleaning.clean_text(F.col(f"`{c}`"))
    or_empty = lambda c: F.coalesce(c, F.lit(""))
    account = ident("ACCTNUM")
    account = F.when(account.rlike("^[0-9]+$") & (F.concat(F.lit("MR"), account) == vocab.MA_ACCOUNT), vocab.MA_ACCOUNT).otherwise(account)
    amount, kind = F.col("`USD Amount`"), F.col("kinds.amount")
    return flat.select(
        row_idx.cast("bigint").alias("row_idx"), ident("PERIOD").alias("period"), account.alias("acctnum"),
        ident("REF").alias("ref"), ident("ENTITYID").alias("entityid"), text("DEPARTMENT").alias("department"),
        text("Category").alias("category"), cleaning.parse_amount(amount, kind).alias("amount"),
        cleaning.amount_was_blank(amount, kind).alias("amount_was_blank"), cleaning.clean_currency(F.col("OCURRCODE")).alias("currency"),
        text("DESCRPN").alias("descrptn"), text("ADDLDESC").alias("adddesc"), or_empty(text("SOURCE")).alias("source"),
        cleaning.clean_date(F.col("ENTRDATE"), F.col("kinds.date")).alias("entrdate"), text("USERID").alias("userid"),
        text("Image URL - Hyperlink").alias("invoice_url"),
    )


def validate(cells: DataFrame, preferred: str | None = None) -> DataFrame:
    """Checklist per file: readable, no column warning, at least one row; row count; whether it carries results."""
    chosen = choose_sheets(cells, preferred).select("file", "sheet")
    grid = cells.join(chosen, SHEET, "left_semi")
    headers = first_row(grid)
    warned = column_warnings(headers).groupBy("file").agg(F.count(F.lit(1)).alias("warnings"))
    carried = headers.groupBy("file").agg(F.bool_or(_header() == vocab.RESULT_COLUMNS[0]).alias("carries_results"))
    filled = grid.where("row_no > 1 and value is not null").groupBy("file", "row_no").count()
    counted = filled.groupBy("file").agg(F.count(F.lit(1)).alias("row_count"))
    rows = F.coalesce("row_count", F.lit(0))
    return chosen.join(warned, "file", "left").join(carried, "file", "left").join(counted, "file", "left").select(
        "file", F.lit(True).alias("format_ok"), F.col("warnings").isNull().alias("structure_ok"),
        (rows > 0).alias("records_ok"), rows.alias("row_count"), F.coalesce("carries_results", F.lit(False)).alias("carries_results"),
    )
