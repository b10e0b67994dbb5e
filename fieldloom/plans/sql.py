"""The rendered inputs as common table expressions for the SQL twins."""

from __future__ import annotations

VOTES = """
base AS (
  SELECT o_orderkey AS k, o_custkey, o_totalprice, o_orderdate, voter, o
  FROM orders, (VALUES ('docling', 0), ('impira', 1), ('layoutlm', 2), ('donut', 3), ('ocr_rapid', 4), ('ocr_fused', 5)) v(voter, o)
  WHERE (o_orderkey + o) % 7 <> 0
), votes AS (
  SELECT k AS doc_id, voter, o AS voter_ord, (60 + (k * 7 + o * 13) % 40) :: DOUBLE AS confidence, field,
    CASE field
      WHEN 'total_amount' THEN (round(o_totalprice * 100) :: BIGINT + CASE WHEN (k * 3 + o) % 4 = 0 THEN 1 ELSE 0 END) :: VARCHAR
      WHEN 'invoice_number' THEN CASE WHEN (k + o) % 3 = 0 THEN 'inv-' ELSE 'INV-' END || strftime(o_orderdate, '%Y') || '-' || k
      WHEN 'vendor_name' THEN CASE WHEN (k + o) % 5 < 2 THEN 'Supplier ' ELSE 'SUPPLIER   ' END || (o_custkey + (k + o) % 2)
      ELSE ['USD', 'EUR', 'usd'][(k + o) % 3 + 1] END AS value
  FROM base, (VALUES ('total_amount'), ('invoice_number'), ('vendor_name'), ('currency')) f(field)
)"""

TALLY = (
    VOTES
    + """, tally AS (
  SELECT doc_id, field, trim(regexp_replace(lower(coalesce(value, '')), '\\s+', ' ', 'g')) AS key,
    count(*) :: INT AS votes, min(voter_ord) AS first_ord, avg(confidence) AS mean_confidence,
    sum(confidence * CASE voter WHEN 'docling' THEN 1.2 WHEN 'layoutlm' THEN 1.1 WHEN 'ocr_rapid' THEN 0.7 WHEN 'ocr_fused' THEN 1.2 ELSE 1.0 END) AS weighted,
    bool_or(voter = 'docling') AS preferred, list(voter ORDER BY voter_ord) AS voters, arg_min(value, voter_ord) AS original
  FROM votes GROUP BY ALL
), ranked AS (
  SELECT *, sum(votes) OVER w AS n, max(votes) OVER w AS most,
    row_number() OVER (PARTITION BY doc_id, field ORDER BY votes DESC, preferred DESC, round(weighted, 6) DESC, first_ord) AS place,
    array_to_string(list(key || '=' || votes) OVER (PARTITION BY doc_id, field ORDER BY first_ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), ';') AS tally
  FROM tally WINDOW w AS (PARTITION BY doc_id, field)
), levelled AS (
  SELECT *, CASE WHEN n >= 4 THEN CASE most WHEN 4 THEN 'unanimous' WHEN 3 THEN 'strong' WHEN 2 THEN 'moderate' ELSE 'conflict' END
    WHEN n = 3 THEN CASE most WHEN 3 THEN 'unanimous' WHEN 2 THEN 'strong' ELSE 'weak' END
    WHEN n = 2 THEN CASE most WHEN 2 THEN 'unanimous' ELSE 'conflict' END ELSE 'weak' END AS agreement
  FROM ranked WHERE place = 1
), resolved AS (
  SELECT doc_id, field, key AS value, agreement, voters, original, tally,
    round(greatest(10.0 :: DOUBLE, least(99.0 :: DOUBLE,
      least(99.0 :: DOUBLE, mean_confidence * CASE agreement WHEN 'unanimous' THEN 1.15 WHEN 'strong' THEN 1.1 WHEN 'moderate' THEN 1.0 WHEN 'weak' THEN 0.9 ELSE 0.8 END :: DOUBLE)
      * CASE voters[1] WHEN 'docling' THEN 1.1 WHEN 'layoutlm' THEN 1.05 WHEN 'donut' THEN 0.95 ELSE 1.0 END :: DOUBLE
      * CASE field WHEN 'invoice_number' THEN 1.1 WHEN 'total_amount' THEN 0.9 WHEN 'vendor_name' THEN 0.95 WHEN 'currency' THEN 1.05 ELSE 1.0 END :: DOUBLE
      * CASE agreement WHEN 'unanimous' THEN 1.1 WHEN 'strong' THEN 1.05 WHEN 'moderate' THEN 1.0 WHEN 'weak' THEN 0.9 ELSE 0.75 END :: DOUBLE)), 1) AS confidence
  FROM levelled
)"""
)

DOCUMENTS = """
shown AS (
  SELECT o_orderkey AS doc_id, o_custkey, o_orderdate, round(o_totalprice * 100) :: BIGINT AS cents, o_orderkey AS k FROM orders
), parts AS (
  SELECT *, cents // 100 AS units, lpad((cents % 100) :: VARCHAR, 2, '0') AS rest, cents // 100000 AS high, lpad((cents // 100 % 1000) :: VARCHAR, 3, '0') AS low FROM shown
), docs AS (
  SELECT doc_id, cents, amount_text, date_text, concat_ws(chr(10),
      CASE WHEN k % 11 = 0 THEN 'Credit Note' WHEN k % 7 = 0 THEN 'Quotation' WHEN k % 5 = 0 THEN 'Statement' ELSE 'Invoice' END,
      'Invoice No: INV-' || strftime(o_orderdate, '%Y') || '-' || k, 'Date: ' || date_text, 'Vendor: Northern Trading ' || o_custkey, 'TOTAL: ' || amount_text) AS text
  FROM (SELECT *,
    CASE k % 4 WHEN 0 THEN '$' || CASE WHEN high > 0 THEN high || ',' || low ELSE units :: VARCHAR END || '.' || rest
      WHEN 1 THEN CASE WHEN high > 0 THEN high || '.' || low ELSE units :: VARCHAR END || ',' || rest
      WHEN 2 THEN units || '.' || rest ELSE units || ',' || rest END AS amount_text,
    CASE k % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 2 THEN strftime(o_orderdate, '%d.%m.%Y')
      WHEN 3 THEN strftime(o_orderdate, '%B %-d, %Y') ELSE strftime(o_orderdate, '%-d %b %Y') END AS date_text
    FROM parts)
)"""

CORRECTIONS = """
corrections AS (
  SELECT event_id AS id, user_id AS vendor_id, event_type AS field_name, printf('%.2f', coalesce(round(value, 2), 0)) AS corrected_value,
    [((event_id * 3) % 100) / 100.0, ((event_id * 5) % 100) / 100.0, ((event_id * 7) % 100) / 100.0, ((event_id * 11) % 100) / 100.0] AS bbox,
    (event_id % 3 + 1) :: INT AS page_number, ts AS created_at
  FROM events
)"""
