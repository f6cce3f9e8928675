"""SQL statements of the sample tables and of common expressions, for the result checks.

They state the same results independently of the DataFrame code: lists instead of single
replacements, sequential rules instead of set-based ones, cross products instead of keyed joins.
"""

from __future__ import annotations

SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def strip(x: str) -> str:
    return f"trim({x}, {SPACE})"


def collapse(x: str) -> str:
    lines = rf"string_split_regex(coalesce({x}, ''), '\r\n|\r|\n')"
    return (f"array_to_string(list_filter(list_transform({lines}, lambda l: {strip('l')}), "
            f"lambda l: l <> ''), chr(10))")


# References that the sample's bodies get at their end, and what they stand for.
PLANTED = [("&eacute;", "é"), ("&#8217;", "’"), ("&euro;", "€"), ("&#x41;", "A"), ("&#150;", "–")]


def decode(x: str) -> str:
    for entity, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"),
                         ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&ndash;", "–"),
                         ("&mdash;", "—"), ("&hellip;", "…"), *PLANTED, ("&amp;", "&")]:
        x = f"replace({x}, '{entity}', '{char}')"
    return x


def html_text(x: str) -> str:
    s = (rf"regexp_replace(coalesce({x}, ''), "
         r"'(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', chr(10), 'g')")
    s = rf"regexp_replace({s}, '(?s)<[!/?A-Za-z][^>]*>', chr(10), 'g')"
    return collapse(decode(decode(s)))


def rtf_text(x: str) -> str:
    return collapse(decode(f"replace(replace(coalesce({x}, ''), '{{', ''), '}}', '')"))


def last_header(text: str, name: str) -> str:
    found = f"regexp_extract_all({text}, '(?im)^{name}:(.*)$', 1)[-1]"
    return strip(f"coalesce({found}, '')")


def mask(x: str) -> str:
    for key, pattern in [  # fixed values: masking patterns
        ("EMAIL", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}(?:\.[a-zA-Z]{2,})?"),
        ("PHONE", r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"),
        ("IP", r"(?:\b(?:\d{1,3}\.){3}\d{1,3}\b)|(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}"),
        ("URL", r"https?://(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}(?:/[^?@<\s]*(?:\?[^@<\s]*)?)?"),
    ]:
        x = f"regexp_replace({x}, '{pattern}', '<{key}>', 'g')"
    return x


def split_list(x: str) -> str:
    return (f"list_filter(list_transform(string_split(replace(coalesce({x}, ''), ',', ';'), ';'), "
            f"lambda p: {strip('p')}), lambda p: p <> '')")


MAILBOX = r"""
base AS (
  SELECT c.conv_id AS c, c.turn AS t, c.role, c.text, p.html,
    CASE WHEN c.conv_id % 4 = 0 THEN chr(13) || chr(10) ELSE chr(10) END AS eol
  FROM conversations c LEFT JOIN pages p ON p.page_id = c.conv_id),
filed AS (
  SELECT *,
    CASE role WHEN 'user' THEN '/Root/Inbox' WHEN 'assistant' THEN '/Root/Sent' ELSE '/Root/System/Notices' END AS folder_path,
    CASE role WHEN 'user' THEN 2 WHEN 'assistant' THEN 3 ELSE 4 END AS folder_rank FROM base
  UNION ALL SELECT *, '/Root/Archive', 1 FROM base WHERE c % 10 = 0),
mailbox AS (
  SELECT folder_path, c * 65536 + t AS pos, (folder_rank::BIGINT << 44) + c * 65536 + t AS scan_pos,
    CASE WHEN (c + t) % 11 = 0 THEN '' ELSE '<c' || c || '.' || t || '@mail.example.com>' END AS internet_message_id,
    CASE WHEN t > 0 THEN 'Re: ' ELSE '' END || 'Conversation ' || c AS subject,
    'User ' || (c % 17) AS sender_name,
    CASE WHEN c % 13 = 0 THEN '' ELSE 'User' || (c % 17) || '@Dept' || (c % 3) || '.Example.com' END AS sender_email_address,
    'user' || (c % 5) || '@Example.org; Team ' || (t % 4) || ', None;' AS display_to,
    CASE WHEN t > 0 THEN 'cc' || (t % 3) || '@example.net' END AS display_cc,
    CASE WHEN t > 0 THEN 'bcc' || (c % 4) || '@example.net' END AS display_bcc,
    TIMESTAMP '2024-01-01' + to_minutes(c * 60 + t) AS delivery_time,
    CASE WHEN c % 7 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(c * 60 + t - 1) END AS client_submit_time,
    CASE WHEN t % 2 = 0 THEN text END AS plain_text_body,
    CASE WHEN t % 2 = 1 AND c % 5 <> 0 THEN html || '<p>Caf&eacute; it&#8217;s &euro;5 &#x41;&#150;</p>' END AS html_body,
    CASE WHEN t % 2 = 1 AND (c % 5 = 0 OR html IS NULL) THEN '{\rtf1 ' || text || '}' END AS rtf_body,
    CASE WHEN role = 'system' THEN 'REPORT.IPM.Note' ELSE 'IPM.Note' END AS message_class,
    'Received: from mx' || (c % 5) || '.example.net' || eol || chr(9) || 'by relay' || (t % 2) || '.example.net' || eol
    || 'Received: from origin.example.org' || eol
    || 'Subject: ' || CASE WHEN t > 0 THEN 'Re: ' ELSE '' END || 'Conversation ' || c || eol
    || CASE WHEN t = 0 THEN '' ELSE
         CASE WHEN c % 9 = 4 THEN 'References: bare-' || c
              ELSE 'References: <c' || c || '.0@mail.example.com>' || eol || ' <c' || c || '.' || (t - 1) || '@mail.example.com>' END || eol
         || CASE WHEN c % 9 = 4 AND c % 2 = 0 THEN '' ELSE 'In-Reply-To: <c' || c || '.' || (t - 1) || '@mail.example.com>' || eol END END
    || 'Reply-To: old' || (c % 6) || '@example.com' || eol || 'reply-to: Desk' || (c % 6) || '@example.com' || eol
    || 'Return-Path: bounce' || (c % 3) || '@example.com' || eol || 'X-Mailer: Mailer ' || (c % 2) || eol
    || 'Content-Type: text/plain' || eol || 'X-Trace: ' || c AS transport_headers,
    (t % 3)::INTEGER AS number_of_attachments, (c % 3 - 1)::INTEGER AS priority, t % 2 = 0 AS is_read
  FROM filed)"""

RECORDS = MAILBOX + rf""",
unfolded AS (
  SELECT *, replace(transport_headers, chr(13), '') AS h,
    regexp_replace(replace(transport_headers, chr(13), ''), '[ \t]*\n[ \t]+', ' ', 'g') AS hu FROM mailbox),
threads AS (
  SELECT *, regexp_replace({last_header('hu', 'references')}, '\s+', ' ', 'g') AS refs,
    regexp_replace({last_header('hu', 'in-reply-to')}, '\s+', ' ', 'g') AS parent FROM unfolded),
records AS (
  SELECT folder_path, pos, scan_pos, is_read,
    CASE WHEN trim(internet_message_id) <> '' THEN substr(sha256(internet_message_id), 1, 16)
      ELSE substr(md5(subject || '|' || CASE WHEN sender_email_address <> '' THEN sender_email_address ELSE sender_name END
        || '|' || strftime(delivery_time, '%Y-%m-%d %H:%M:%S')), 1, 16) END AS "Email_ID",
    strftime(delivery_time, '%Y-%m-%d %H:%M:%S') AS "Date_Received", epoch(delivery_time)::DOUBLE AS "Date_Received_Timestamp",
    coalesce(strftime(client_submit_time, '%Y-%m-%d %H:%M:%S'), '') AS "Date_Sent", epoch(client_submit_time)::DOUBLE AS "Date_Sent_Timestamp",
    CASE WHEN sender_email_address <> '' THEN sender_name || ' <' || sender_email_address || '>' ELSE sender_name END AS "From",
    sender_email_address AS "Sender_Email", display_to AS "To", coalesce(display_cc, '') AS "CC", coalesce(display_bcc, '') AS "BCC",
    {last_header('h', 'reply-to')} AS "Reply_To", subject AS "Subject",
    coalesce(nullif({collapse('plain_text_body')}, ''), nullif({html_text('html_body')}, ''), nullif({rtf_text('rtf_body')}, ''), '') AS "Body",
    coalesce(html_body, '') AS "HTML_Body",
    CASE priority WHEN 1 THEN 'High' WHEN -1 THEN 'Low' ELSE 'Normal' END AS "Importance",
    number_of_attachments AS "Attachment_Count", internet_message_id AS "Message_ID", message_class AS "Content_Type",
    {last_header('h', 'x-mailer')} AS "Email_Client", {last_header('h', 'return-path')} AS "Return_Path", message_class AS "Client_Info",
    coalesce(nullif(regexp_extract(refs, '<[^<>\s]*>'), ''), nullif(parent, ''), internet_message_id) AS "Thread_ID",
    parent AS "Parent_ID", refs AS "References",
    array_to_string(list_transform(regexp_extract_all(hu, '(?im)^(received:.*)$', 1), lambda x: {strip('x')}), '; ') AS "Received_Hops",
    transport_headers AS "Full_Headers", hu
  FROM threads)"""

# Records after duplicate removal: sequential keep-first by Email_ID (never empty here).
UNIQUE = RECORDS + """,
kept AS (SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY "Email_ID" ORDER BY scan_pos) = 1)"""

TRAFFIC = r"""
traffic AS (
  SELECT l_linenumber, l_partkey, l_suppkey, '/Root/' || o_orderpriority AS folder_path,
    '<o' || o_orderkey || '@orders.example.com>' AS "Message_ID",
    lower(replace(c_name, '#', '') || '@' || c_mktsegment || '.example.com') AS "Sender_Email",
    'supplier' || l_suppkey || '@parts.example.com; Part' || (l_partkey % 97) || '@Stock.Example.com, none' AS "To",
    CASE WHEN o_orderpriority LIKE '1%' THEN 'audit@example.org' ELSE '' END AS "CC",
    CASE WHEN l_returnflag = 'R' THEN 'returns@example.org' ELSE '' END AS "BCC",
    CASE WHEN o_orderstatus = 'F' THEN 'billing@example.com' ELSE '' END AS "Reply_To",
    CASE WHEN o_orderstatus = 'P' THEN 'bounce@example.com' ELSE '' END AS "Return_Path",
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS "Date_Received", o_orderkey, o_custkey,
    'Received: from mx' || (o_custkey % 20) || '.example.net by relay' || (l_suppkey % 3) || '.example.net' AS "Received_Hops"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey)"""


def mentions(source: str) -> str:
    """One row per address mention of a record table: address and role, by six separate selections."""
    single = [("Sender_Email", "sender"), ("Reply_To", "reply-to"), ("Return_Path", "return-path")]
    many = [("To", "to"), ("CC", "cc"), ("BCC", "bcc")]
    parts = [f"""SELECT "{f}" AS a, '{r}' AS role FROM {source}""" for f, r in single]
    parts += [f"""SELECT unnest({split_list(f'"{f}"')}) AS a, '{r}' AS role FROM {source}""" for f, r in many]
    return f"""
raw_mentions AS ({' UNION ALL '.join(parts)}),
mentions AS (SELECT lower({strip('a')}) AS address, role FROM raw_mentions
  WHERE a IS NOT NULL AND {strip('a')} <> '' AND lower({strip('a')}) <> 'none'),
mention_parts AS (SELECT address, role,
  CASE WHEN strpos(address, '@') > 0 THEN substr(address, strpos(address, '@') + 1) ELSE '' END AS domain,
  CASE WHEN strpos(address, '@') > 0 THEN substr(address, 1, strpos(address, '@') - 1) ELSE address END AS name FROM mentions)"""


ATTACHMENTS = r"""
att0 AS (SELECT *, doc_id // 3 AS k, doc_id % 3 AS i FROM documents),
att1 AS (SELECT *,
    CASE WHEN k % 9 = 0 AND i = 1 THEN 'Report 0_2' ELSE 'Report ' || CASE WHEN k % 7 = 0 THEN '*?: ' ELSE '' END || (i % 2) END
    || (['.txt', '.csv', '.xml', '.pdf', '.docx', '.png', '.zip', ''])[(k % 8 + 1)::INTEGER] AS fname FROM att0),
att AS (SELECT doc_id, '/Root/Inbox' AS folder_path, k AS message_index, i AS attachment_index,
    CASE WHEN doc_id % 17 <> 0 THEN fname ELSE '' END AS long_filename,
    CASE WHEN doc_id % 34 <> 0 THEN fname ELSE '' END AS file_name,
    CASE WHEN doc_id % 50 = 7 THEN '200000000' WHEN doc_id % 51 = 0 THEN '-5' WHEN doc_id % 53 = 0 THEN '60000000'
      WHEN doc_id % 59 = 0 THEN 'unknown' ELSE n_chars::VARCHAR END AS size,
    CASE WHEN doc_id % 61 = 0 THEN ''::BLOB WHEN doc_id % 13 = 0 THEN '\x89\x50\x4E\x47\x0D\x0A\x1A\x0A'::BLOB
      ELSE encode(CASE WHEN doc_id % 11 = 0 THEN '%PDF-' WHEN doc_id % 3 = 1 AND k % 8 = 4 OR doc_id % 29 = 0 THEN 'PK' || chr(3) || chr(4)
        WHEN doc_id % 23 = 0 THEN 'BM' ELSE '' END || text) END AS content,
    CASE WHEN doc_id % 61 = 0 THEN '' WHEN doc_id % 13 = 0 THEN chr(65533) || 'PNG' || chr(13) || chr(10) || chr(26) || chr(10)
      ELSE CASE WHEN doc_id % 11 = 0 THEN '%PDF-' WHEN doc_id % 3 = 1 AND k % 8 = 4 OR doc_id % 29 = 0 THEN 'PK' || chr(3) || chr(4)
        WHEN doc_id % 23 = 0 THEN 'BM' ELSE '' END || text END AS content_text,
    coalesce(nullif(CASE WHEN doc_id % 17 <> 0 THEN fname ELSE '' END, ''),
      nullif(CASE WHEN doc_id % 34 <> 0 THEN fname ELSE '' END, '')) AS given_name
  FROM att1),
guarded AS (SELECT *, CASE
    WHEN try_cast(size AS DOUBLE) IS NULL THEN 'size is not a number'
    WHEN try_cast(size AS DOUBLE) > 104857600 THEN 'stated size over limit'
    WHEN try_cast(size AS DOUBLE) < 0 THEN 'negative size'
    WHEN octet_length(content) > 104857600 THEN 'content over limit'
    WHEN octet_length(content) = 0 THEN 'no content' END AS rejection,
    substr(coalesce(nullif(regexp_replace(regexp_replace(replace(
      coalesce(nullif(trim(given_name), ''), 'attachment_' || attachment_index), ' ', '_'),
      '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'attachment_' || attachment_index), 1, 255) AS safe_name FROM att)"""

# Names given one by one in attachment order, remembering all names given before.
STORED = ATTACHMENTS + r""",
queue AS (SELECT folder_path, message_index, attachment_index, safe_name,
    regexp_replace(safe_name, '\.[^.]+$', '') AS stem, regexp_extract(safe_name, '\.[^.]+$') AS suffix,
    row_number() OVER (PARTITION BY folder_path, message_index ORDER BY attachment_index) AS turn
  FROM guarded WHERE rejection IS NULL),
given AS (
  SELECT folder_path, message_index, attachment_index, turn, safe_name AS stored_name, [safe_name] AS taken FROM queue WHERE turn = 1
  UNION ALL
  SELECT folder_path, message_index, attachment_index, turn, pick, list_append(taken, pick) FROM (
    SELECT q.folder_path, q.message_index, q.attachment_index, q.turn, g.taken,
      CASE WHEN NOT list_contains(g.taken, q.safe_name) THEN q.safe_name
        ELSE list_filter(list_transform(range(2, 50), lambda n: q.stem || '_' || n || q.suffix), lambda s: NOT list_contains(g.taken, s))[1] END AS pick
    FROM given g JOIN queue q ON q.folder_path = g.folder_path AND q.message_index = g.message_index AND q.turn = g.turn + 1) step),
stored AS (SELECT folder_path, message_index, attachment_index, stored_name FROM given)"""

# fixed values: types by extension
MIME_BY_NAME = r"""CASE lower(regexp_extract({n}, '\.([^.]*)$', 1))
    WHEN 'pdf' THEN 'application/pdf'
    WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
    WHEN 'txt' THEN 'text/plain' WHEN 'csv' THEN 'text/csv' WHEN 'xml' THEN 'text/xml' WHEN 'png' THEN 'image/png'
    ELSE 'application/octet-stream' END"""


def mime_by_name(n: str) -> str:
    return MIME_BY_NAME.replace("{n}", n)


DESCRIBED = STORED + rf""",
typed AS (SELECT g.*, octet_length(content) AS n_bytes,
    CASE WHEN hex(content) LIKE '89504E470D0A1A0A%' THEN 'image/png' WHEN hex(content) LIKE '25504446%' THEN 'application/pdf'
      WHEN hex(content) LIKE '504B0304%' AND NOT lower(safe_name) LIKE '%.docx' THEN 'application/zip'
      ELSE {mime_by_name('safe_name')} END AS mime_type FROM guarded g),
routed AS (SELECT *, CASE WHEN mime_type LIKE 'text/%' THEN 'text' WHEN mime_type LIKE 'image/%' THEN 'image'
      WHEN mime_type LIKE '%pdf' OR mime_type LIKE '%document' THEN 'document'
      WHEN mime_type = 'application/zip' THEN 'archive' ELSE 'binary' END AS content_type,
    CASE WHEN mime_type LIKE 'text/%' THEN 'direct' WHEN mime_type LIKE '%pdf' THEN 'pdf_text_layer'
      WHEN mime_type LIKE '%document' THEN 'docx_native' WHEN mime_type LIKE 'image/%' THEN 'ocr' ELSE 'fallback' END AS method
  FROM typed)"""

FOLDERS = """
used AS (SELECT DISTINCT folder_path FROM mailbox),
folders AS (SELECT folder_path, string_split(folder_path, '/')[-1] AS name,
    regexp_replace(folder_path, '/[^/]*$', '') AS parent_path
  FROM (SELECT folder_path FROM used UNION SELECT '/Root' UNION SELECT '/Root/System' UNION SELECT '/Root/Drafts')),
counts AS (SELECT f.folder_path, f.name, count(m.folder_path) AS total_count, count(*) FILTER (WHERE NOT m.is_read) AS unread_count
  FROM folders f LEFT JOIN mailbox m ON m.folder_path = f.folder_path GROUP BY ALL)"""

DICTIONARY = r"""
dictionary AS (SELECT word, count(*) AS freq FROM (
  SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM benchmark) GROUP BY word)"""

LINES = DICTIONARY + r""",
doc_words AS (SELECT word, count(*) AS freq FROM (
  SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM conversations) GROUP BY word),
lines AS (
  SELECT 'good' AS source, word AS line_no, CASE WHEN freq % 50 = 49 THEN '# ' || word ELSE ' ' || word || '  ' || freq END AS line FROM dictionary
  UNION ALL SELECT 'bad', word, CASE WHEN length(word) % 2 = 0 THEN word || ' many' ELSE word || ' ' || freq END FROM dictionary
  UNION ALL SELECT 'mixed', word, CASE WHEN length(word) = 17 THEN word || ' two words ' || freq
    WHEN length(word) = 19 THEN word || ' -' || freq ELSE word || chr(9) || (freq + 1) END FROM doc_words),
cells AS (SELECT *, string_split_regex(trim(line), '\s+') AS f FROM lines),
parsed AS (SELECT source, line_no, CASE WHEN len(f) = 2 THEN f[1] END AS word, CASE WHEN len(f) = 2 THEN try_cast(f[2] AS BIGINT) END AS freq,
    trim(line) = '' OR trim(line) LIKE '#%' AS skip FROM cells),
head AS (SELECT * FROM parsed QUALIFY row_number() OVER (PARTITION BY source ORDER BY line_no) <= 1000),
checked AS (SELECT source, count(*) FILTER (WHERE NOT skip AND freq >= 0) AS valid,
    count(*) FILTER (WHERE NOT skip AND (freq IS NULL OR freq < 0)) AS invalid FROM head GROUP BY source),
verdict AS (SELECT source, valid, invalid, CASE WHEN valid = 0 THEN 'No valid word-frequency pairs found'
    WHEN invalid > valid * 0.1 THEN 'Too many invalid lines: ' || invalid || '/' || (valid + invalid) ELSE '' END AS message FROM checked)"""


def query(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes.strip()}\n{select}"
