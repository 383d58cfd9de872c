"""Checking SQL shared by several topics: mined keys and triage, written apart from the Spark expressions."""

from __future__ import annotations

from ..registry import part

_A = r"(?i)\bINV[\s#\-.:]*([A-Z0-9][A-Z0-9\-/]{3,})"
_B = r"(?i)^([A-Z0-9][A-Z0-9\-/.]{4,})\s{2,}"


def _usable(token: str) -> str:
    return (
        f"({token} <> '' and regexp_matches({token}, '[0-9]') "
        f"and not regexp_full_match({token}, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}'))"
    )


def _standalone(words: str) -> str:
    """1-based position of the first usable word in the list column `words`, else null."""
    core = lambda at: f"trim(coalesce({words}[{at}], ''), '.,;:()[]\"''')"
    prev = f"case when i > 1 then {core('i - 1')} else '' end"
    return (
        f"list_filter(range(1, len({words}) + 1), lambda i: regexp_full_match({core('i')}, '(?i)[A-Z0-9][A-Z0-9\\-/]{{4,}}') "
        f"and {_usable(core('i'))} and (regexp_full_match({prev}, '[A-Za-z]{{3,}}') "
        f"or regexp_full_match({core('i + 1')}, '[A-Za-z]{{3,}}')))[1]"
    )


def _scan(field: str) -> str:
    """Columns for one text field: tokens of the three kinds, and what follows the prefixed one."""
    words = f"{field}_words"
    return f"""
 case when {_usable(f"regexp_extract({field}, '{_A}', 1)")} then regexp_extract({field}, '{_A}', 1) end as {field}_a,
 case when {_usable(f"regexp_extract({field}, '{_B}', 1)")} then regexp_extract({field}, '{_B}', 1) end as {field}_b,
 {_standalone(words)} as {field}_at"""


part("text_words", ("ledger",), """
select *, list_filter(string_split_regex(descrptn, '\\s+'), lambda w: w <> '') as descrptn_words,
 list_filter(string_split_regex(adddesc, '\\s+'), lambda w: w <> '') as adddesc_words from ledger
""")
part("text_tokens", ("text_words",), f"select *, {_scan('descrptn')}, {_scan('adddesc')} from text_words")
part("mined", ("text_tokens",), """
select * exclude (token, d_end, descrptn_words, adddesc_words, descrptn_a, descrptn_b, descrptn_at, adddesc_a, adddesc_b, adddesc_at),
 regexp_replace(regexp_replace(upper(token), '^INV[\\s#\\-.:]*', ''), '[^A-Z0-9]', '', 'g') as key,
 coalesce(d_end and length(descrptn) >= 40, false) as truncated
from (select *,
  coalesce(descrptn_a, descrptn_b, trim(descrptn_words[descrptn_at], '.,;:()[]"'''),
           adddesc_a, adddesc_b, trim(adddesc_words[adddesc_at], '.,;:()[]"''')) as token,
  case when descrptn_a is not null then strpos(descrptn, regexp_extract(descrptn, '(?i)\\bINV[\\s#\\-.:]*[A-Z0-9][A-Z0-9\\-/]{3,}', 0))
            + length(regexp_extract(descrptn, '(?i)\\bINV[\\s#\\-.:]*[A-Z0-9][A-Z0-9\\-/]{3,}', 0)) > length(descrptn)
       when descrptn_b is not null then false
       when descrptn_at is not null then descrptn_at = len(descrptn_words) and trim(descrptn_words[descrptn_at], '.,;:()[]"''') = descrptn_words[-1]
            and ends_with(descrptn, descrptn_words[-1]) end as d_end
 from text_tokens) t
""")
part("triaged", ("mined",), """
select *, coalesce(invoice_url, '') <> '' or key is not null as referenced,
 case when coalesce(descrptn, '') ilike '%reclass%' or coalesce(adddesc, '') ilike '%reclass%' then 'reclass'
  when upper(trim(userid)) = 'CLOSEGL' then
   case when regexp_matches(concat(coalesce(category, ''), '|', coalesce(descrptn, '')), '(?i)acquisi|disposi|merger|transaction|deal')
        then 'close_guard' else 'close' end
  when amount < 0 then 'negative' else 'scorer' end as rule
from mined
""")
part("settled", ("triaged",), """
select row_idx, acctnum, amount, currency, period, category, descrptn, entrdate, invoice_url, key, rule,
 case rule when 'reclass' then 'reclass' when 'close_guard' then 'human_review' when 'close' then 'recurring' else 'skipped_negative' end as classification,
 case rule when 'reclass' then 'reclass_rule' when 'close' then 'closegl_rule' else 'none' end as basis,
 case when referenced then 'yes' else 'no' end as had_invoice,
 concat_ws(',', case when amount_was_blank then 'amount_blank' end, case when rule = 'reclass' then 'reclass_rule' end,
  case when referenced then 'had_invoice' end, case when rule in ('close', 'close_guard') then 'closegl_user' end,
  case when rule = 'negative' then 'skipped_negative' end) as flags
from triaged where rule <> 'scorer'
""")
