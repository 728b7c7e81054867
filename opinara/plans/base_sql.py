"""The fixture views as DuckDB common table expressions."""

from __future__ import annotations

from ..functions import lexicons as L
from ..sources.fixtures import LATE_FROM, LATE_TERM, TERMS


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(words) -> str:
    return ", ".join(lit(w) for w in words)


MAP_CTE = "aspect_map(variant, canonical) as (values " + ", ".join(
    f"({lit(v)}, {lit(c)})" for c, vs in L.ASPECT_VARIANTS.items() for v in vs
) + ")"

MENTIONS_CTE = (
    "terms(ix, term) as (values "
    + ", ".join(f"({i}, {lit(t)})" for i, t in enumerate(TERMS))
    + f"""),
mentions as (
  select cast(l_orderkey as varchar) as review_id,
         cast(o_custkey * 2 as varchar) as parent_asin,
         'u' || cast(cast(floor(l_orderkey / 3) as bigint) as varchar) as user_id,
         cast(l_orderkey % 5 + 1 as double) as rating,
         l_shipdate as timestamp, l_linenumber as pos,
         case when term = 'pump' and cast(l_shipdate as date) >= date '{LATE_FROM}'
              then '{LATE_TERM}' else term end as aspect_term,
         case when l_returnflag = 'R' then 'Negative' when l_returnflag = 'N' then 'Positive'
              when l_orderkey % 5 + 1 >= 4 then 'Positive'
              when l_orderkey % 5 + 1 <= 2 then 'Negative' else 'Neutral' end as sentiment,
         l_quantity / 50.0 as confidence,
         l_linestatus = 'F' as verified_purchase,
         l_linenumber - 1 as helpful_vote
  from lineitem join orders on l_orderkey = o_orderkey join terms on l_partkey % {len(TERMS)} = ix)"""
)

PRODUCTS_CTE = """products as (
  select cast(p_partkey as varchar) as parent_asin, p_name as title, p_type as main_category,
         1 + (p_size % 41) / 10.0::double as average_rating,
         case when p_partkey % 7 = 0 then 'None' else cast(p_retailprice as varchar) end as price
  from part)"""

NORM_CTE = """normed as (
  select m.*, coalesce(canonical, lower(trim(aspect_term))) as aspect_term_normalized
  from mentions m left join aspect_map on lower(trim(aspect_term)) = variant)"""

CLEAN_CTE = f"""deduped as (
  select * from normed
  qualify row_number() over (partition by review_id, aspect_term_normalized
    order by pos, aspect_term, sentiment, confidence, timestamp) = 1),
clean as (
  select d.*, title, main_category, average_rating, price, title is not null as has_metadata,
         case sentiment when 'Positive' then confidence when 'Negative' then -confidence
              else 0.0::double end as sentiment_score,
         cast(date_trunc('month', timestamp) as date) as year_month,
         cast(date_trunc('week', timestamp) as date) as week,
         cast(timestamp as date) as date,
         cast(year(timestamp) as integer) as year, cast(month(timestamp) as integer) as month,
         dayname(timestamp) as day_of_week,
         cast(sentiment = 'Positive' as integer) as is_positive,
         cast(sentiment = 'Negative' as integer) as is_negative,
         cast(sentiment = 'Neutral' as integer) as is_neutral
  from deduped d left join products using (parent_asin)
  where confidence >= 0.5
    and aspect_term_normalized not in ({in_list(L.EXCLUDED_ASPECTS)}))"""

MENTIONS = f"with {MENTIONS_CTE} "
NORMED = f"with {MAP_CTE}, {MENTIONS_CTE}, {NORM_CTE} "
PRODUCTS = f"with {PRODUCTS_CTE} "
CLEAN = f"with {MAP_CTE}, {MENTIONS_CTE}, {PRODUCTS_CTE}, {NORM_CTE}, {CLEAN_CTE} "
CLEAN_MORE = CLEAN.rstrip() + ", "

REVIEWS_CTE = """reviews as (
  select cast(doc_id as varchar) as review_id,
         case when doc_id % 11 <> 0 then cast(doc_id % 5 + 1 as double) end as rating,
         case when doc_id % 10 <> 0 then 'Notes from ' || source end as title, text,
         doc_id % 2 <> 0 as has_image,
         case when doc_id % 13 = 0 then 'bad asin'
              else 'B' || lpad(cast(doc_id % 200 as varchar), 9, '0') end as asin,
         case when doc_id % 17 <> 0 then 'B' || lpad(cast(doc_id % 20 as varchar), 9, '0') end
           as parent_asin,
         case when doc_id % 19 <> 0 then lang || '-' || cast(doc_id % 97 as varchar) end as user_id,
         date '2020-01-01' + cast(doc_id % 366 as integer) as date,
         case when doc_id % 4 <> 3 then cast(doc_id % 4 as integer) end as helpful_vote,
         doc_id % 3 <> 0 as verified_purchase, lang
  from documents)"""
REVIEWS = f"with {REVIEWS_CTE} "
REVIEWS_MORE = f"with {REVIEWS_CTE}, "

EVENTS_CTE = """ev as (
  select cast(event_id as varchar) as review_id, cast(user_id as varchar) as user_id,
         json_extract_string(props, '$.k') as parent_asin,
         cast(event_id % 5 + 1 as double) as rating, event_type as main_category, value, ts
  from events)"""
EVENTS = f"with {EVENTS_CTE} "
EVENTS_MORE = f"with {EVENTS_CTE}, "
