"""One statement per query, put together from named steps (common table expressions).

The statements follow the meaning of each operator, not the shape of its Spark plan: splits by
ranking, TF-IDF in long form by joins, ROC by windows over all points, mail decoding by the texts
the mails were composed from.
"""

from __future__ import annotations

from hamsieve.functions import fixed

# The statements' own copies of the two lists.
STOP_WORDS = """
a about above across after afterwards again against all almost alone along already also although always am
among amongst amoungst amount an and another any anyhow anyone anything anyway anywhere are around as at back
be became because become becomes becoming been before beforehand behind being below beside besides between
beyond bill both bottom but by call can cannot cant co con could couldnt cry de describe detail do done down
due during each eg eight either eleven else elsewhere empty enough etc even ever every everyone everything
everywhere except few fifteen fifty fill find fire first five for former formerly forty found four from front
full further get give go had has hasnt have he hence her here hereafter hereby herein hereupon hers herself
him himself his how however hundred i ie if in inc indeed interest into is it its itself keep last latter
latterly least less ltd made many may me meanwhile might mill mine more moreover most mostly move much must my
myself name namely neither never nevertheless next nine no nobody none noone nor not nothing now nowhere of
off often on once one only onto or other others otherwise our ours ourselves out over own part per perhaps
please put rather re same see seem seemed seeming seems serious several she should show side since sincere six
sixty so some somehow someone something sometime sometimes somewhere still such system take ten than that the
their them themselves then thence there thereafter thereby therefore therein thereupon these they thick thin
third this those though three through throughout thru thus to together too top toward towards twelve twenty
two un under until up upon us very via was we well were what whatever when whence whenever where whereafter
whereas whereby wherein whereupon wherever whether which while whither who whoever whole whom whose why will
with within without would yet you your yours yourself yourselves
""".split()
NOISE_PATTERNS = (
    "content-transfer-encoding",
    "content-type:",
    "content-id:",
    "image/gif",
    "image/jpeg",
    "image/png",
    "application/",
    "multipart/",
    "boundary=",
    "charset=",
    "name=",
    "filename=",
    "base64",
    "quoted-printable",
)

WS = r"\s\x0B\x1C-\x1F\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
NL = "chr(10)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(expr: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(to)}, 'g')"


def trim_ws(expr: str) -> str:
    return sub(expr, rf"\A[{WS}]+|[{WS}]+\z")


def squeeze(expr: str) -> str:
    return f"trim({sub(expr, rf'[{WS}]+', ' ')})"


def entities(expr: str) -> str:
    for name, char in (("middot", "·"), ("copy", "©"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        expr = f"replace({expr}, '&{name};', '{char}')"
    return expr


def no_markup(expr: str) -> str:
    for pattern in (
        r"(?s)<!--.*?-->",
        r"(?s)<script[^>]*>.*?</script>",
        r"(?s)<style[^>]*>.*?</style>",
        r"(?s)<template[^>]*>.*?</template>",
        r"<[!?][^>]*>",
        r"</?[a-z][^>]*>",
    ):
        expr = sub(expr, pattern)
    return expr


def html(expr: str) -> str:
    low = f"lower({expr})"
    return (
        f"CASE WHEN contains({low}, '<') AND contains({low}, '>') "
        f"THEN {entities(no_markup(low))} ELSE {low} END"
    )


def clean(expr: str, profile: str = "corpus") -> str:
    if profile == "model":
        return squeeze(f"lower({expr})")
    if profile == "corpus":
        out = sub(html(expr), rf"https?://[^{WS}]+|www\.[^{WS}]+")
        out = sub(out, rf"[^{WS}]+@[^{WS}]+")
        return squeeze(sub(out, rf"[^{WORD}{WS}.,!?-]", " "))
    out = sub(entities(no_markup(f"lower({expr})")), rf"http[^{WS}]+|www[^{WS}]+|https[^{WS}]+")
    out = sub(out, rf"[^{WS}]+@[^{WS}]+")
    return squeeze(sub(out, rf"[^{WORD}{WS}]", " "))


def noise(expr: str) -> str:
    return "(" + " OR ".join(f"contains(lower({expr}), {q(p)})" for p in NOISE_PATTERNS) + ")"


def valid(expr: str) -> str:
    return f"(length({trim_ws(expr)}) >= 10 AND NOT {noise(expr)})"


def tokens(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), '[{WORD}]{{2,}}')"


def key(expr: str) -> str:
    return f"md5('{fixed.SEED}:' || CAST({expr} AS VARCHAR))"


def with_(*steps: str) -> str:
    return "WITH " + ",\n".join(steps) + "\n"


# --- steps -------------------------------------------------------------------------------------

MAILS = f"""mails AS (
  SELECT doc_id AS id, lang, source,
    CASE WHEN contains(text, {NL}) THEN substr(text, 1, strpos(text, {NL}) - 1) ELSE '' END AS subject,
    CASE WHEN contains(text, {NL}) THEN substr(text, strpos(text, {NL}) + 1) ELSE text END AS body
  FROM documents)"""

CLEANED = f"""cleaned AS (
  SELECT *, subject || ' ' || body AS full_text FROM (
    SELECT id, lang, source, {clean('subject')} AS subject, {clean('body')} AS body FROM mails))"""

BLANK = "(subject = '' AND body = '')"

# Language: all trigrams of whole texts; a text is judged by its first 1000 characters.
_GRAM_LIST = "list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])"
GRAMS = f"""grams AS (
  SELECT id, lang, unnest({_GRAM_LIST}) AS gram FROM (
    SELECT id, lang, string_split(substr(full_text, 1, 1000), '') AS c FROM cleaned WHERE length(full_text) > 2))"""
PROFILE = f"""counts AS (
  SELECT lang, gram, count(*) AS n FROM (
    SELECT lang, unnest({_GRAM_LIST}) AS gram FROM (
      SELECT lang, string_split(full_text, '') AS c FROM cleaned WHERE length(full_text) > 2)) GROUP BY ALL),
sizes AS (
  SELECT lang, sum(n) + (SELECT count(DISTINCT gram) FROM counts) AS size FROM counts GROUP BY lang),
known AS (SELECT DISTINCT gram FROM counts),
lp AS (
  SELECT k.gram, s.lang, ln(coalesce(p.n, 0) + 1) - ln(s.size) AS lp
  FROM known k CROSS JOIN sizes s LEFT JOIN counts p ON p.gram = k.gram AND p.lang = s.lang)"""
DETECTED = """scores AS (
  SELECT g.id, lp.lang, round(sum(lp.lp), 6) AS score FROM grams g JOIN lp ON g.gram = lp.gram GROUP BY ALL),
detected AS (
  SELECT id, lang AS detected FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, lang) AS r FROM scores) WHERE r = 1)"""
JUDGED = f"""judged AS (
  SELECT c.*, d.detected,
    CASE WHEN {BLANK} THEN 'blank' WHEN {noise('full_text')} THEN 'noise'
         WHEN length({trim_ws('full_text')}) < 10 THEN 'short'
         WHEN d.detected IS DISTINCT FROM 'en' THEN 'language' ELSE 'accepted' END AS reason
  FROM cleaned c LEFT JOIN detected d ON c.id = d.id)"""
LANGUAGE = (MAILS, CLEANED, GRAMS, PROFILE, DETECTED, JUDGED)

SPLIT_CASE = """CASE WHEN r <= CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT) THEN 'train'
         WHEN r <= CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT)
                 + CAST(floor(n * CAST(0.1 AS DOUBLE)) AS BIGINT) THEN 'validate'
         ELSE 'test' END AS split"""


def split_of(source: str) -> str:
    return f"""corpus AS (
  SELECT id, subject, body, label, {SPLIT_CASE} FROM (
    SELECT *, row_number() OVER (ORDER BY {key('id')}, id) AS r, count(*) OVER () AS n FROM ({source})))"""


LABELLED = """SELECT j.id, subject, body, CAST(l.toxic AS INTEGER) AS label
      FROM judged j JOIN labels l ON j.id = l.doc_id WHERE reason = 'accepted'"""
CORPUS = (*LANGUAGE, split_of(LABELLED))
KEPT = (*LANGUAGE, "kept AS (SELECT id, subject, body FROM judged WHERE reason = 'accepted')")

TERMS = f"""lists AS (
  SELECT id, label, split, list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS t
  FROM (SELECT id, label, split, {tokens("subject || ' ' || body")} AS t FROM corpus)),
tf AS (
  SELECT id, label, split, term, count(*) AS tf
  FROM (SELECT id, label, split, unnest(t) AS term FROM lists) GROUP BY ALL)"""
VOCAB = """size AS (SELECT count(*) AS n FROM corpus WHERE split = 'train'),
vocab AS (
  SELECT term, df, total, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM (
    SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM tf WHERE split = 'train' GROUP BY term), size
  WHERE df >= 2 AND df <= 0.95 * n ORDER BY total DESC, term LIMIT 50000)"""
TFIDF = """weighted AS (
  SELECT id, label, split, tf.term, tf.tf * idf AS w FROM tf JOIN vocab ON tf.term = vocab.term),
tfidf AS (
  SELECT id, label, split, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM weighted)"""
NB = """term_sums AS (
  SELECT c.label, v.term, coalesce(s.total, 0) AS total
  FROM (SELECT DISTINCT label FROM corpus WHERE split = 'train') c CROSS JOIN vocab v
  LEFT JOIN (SELECT label, term, sum(weight) AS total FROM tfidf WHERE split = 'train' GROUP BY ALL) s
    ON s.label = c.label AND s.term = v.term),
theta AS (
  SELECT label, term, ln((total + 1.0) / (sum(total) OVER (PARTITION BY label) + (SELECT count(*) FROM vocab))) AS lp
  FROM term_sums),
prior AS (
  SELECT label, ln(count(*) * 1.0 / (SELECT n FROM size)) AS lp FROM corpus WHERE split = 'train' GROUP BY label),
delta AS (
  SELECT a.term, b.lp - a.lp AS d FROM theta a JOIN theta b ON a.term = b.term AND a.label = 0 AND b.label = 1),
bias AS (
  SELECT (SELECT lp FROM prior WHERE label = 1) - (SELECT lp FROM prior WHERE label = 0) AS b)"""
MODEL = (*CORPUS, TERMS, VOCAB, TFIDF, NB)


def scored(where: str) -> str:
    return f"""sums AS (SELECT id, sum(weight * d) AS s FROM tfidf JOIN delta USING (term) WHERE {where} GROUP BY id),
scored AS (
  SELECT c.id, c.label, c.split, round(p, 9) AS spam_prob, p, CAST(p > 0.5 AS INTEGER) AS pred FROM (
    SELECT c.id, c.label, c.split, 1.0 / (1.0 + exp(-(b + coalesce(s, 0)))) AS p
    FROM corpus c LEFT JOIN sums ON sums.id = c.id, bias WHERE {where.replace('split', 'c.split')}) c)"""


TEST = (*MODEL, scored("split = 'test'"))

METRICS = """SELECT {by} hits / n AS accuracy, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS "precision",
    CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall,
    CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1
  FROM (SELECT {by} CAST(count(*) AS DOUBLE) AS n,
      CAST(count(*) FILTER (label = pred) AS DOUBLE) AS hits,
      CAST(count(*) FILTER (label = 1 AND pred = 1) AS DOUBLE) AS tp,
      CAST(count(*) FILTER (label = 0 AND pred = 1) AS DOUBLE) AS fp,
      CAST(count(*) FILTER (label = 1 AND pred = 0) AS DOUBLE) AS fn
    FROM {source} {group})"""
ROUNDED = """round(accuracy, 6) AS accuracy, round("precision", 6) AS "precision",
  round(recall, 6) AS recall, round(f1, 6) AS f1"""
# Logistic regression in its dual: the weights are a sum of the training mails, so steps along the gradient move one number
# per mail. Accelerated, they settle to the last digits in as many steps.
LR_STEPS = 2500
LOGISTIC = ("""lr_train AS (
  SELECT id, label, row_number() OVER (ORDER BY id) AS i, count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY label)) AS w FROM corpus WHERE split = 'train')""",
"""lr_gram AS (
  SELECT a.i, b.i AS j, sum(x.weight * y.weight) AS k
  FROM lr_train a JOIN tfidf x ON x.id = a.id JOIN tfidf y ON y.term = x.term JOIN lr_train b ON b.id = y.id GROUP BY ALL)""",
"""lr_rows AS (
  SELECT a.i, a.w, CAST(a.label AS DOUBLE) AS y, list(coalesce(k, 0.0) ORDER BY b.i) AS r
  FROM lr_train a CROSS JOIN lr_train b LEFT JOIN lr_gram g ON g.i = a.i AND g.j = b.i GROUP BY a.i, a.w, a.label)""",
"""lr_all AS (
  SELECT list(r ORDER BY i) AS m, list(w ORDER BY i) AS w, list(y ORDER BY i) AS y, count(*) AS n,
    1 / (1 + max(w) * max(list_sum(r)) / 2) AS step, 2 / sum(w) AS bias_step FROM lr_rows)""",
f"""lr_fit(k, a, z, b) AS (
  SELECT 0, list_transform(range(n), lambda i: 0.0::DOUBLE), list_transform(range(n), lambda i: 0.0::DOUBLE), 0.0::DOUBLE FROM lr_all
  UNION ALL
  SELECT k + 1, new_a, list_transform(list_zip(new_a, a), lambda p: p[1] + (1 - sqrt(step)) / (1 + sqrt(step)) * (p[1] - p[2])), b - bias_step * list_sum(g)
  FROM (
    SELECT *, list_transform(list_zip(z, g), lambda p: p[1] - step * (p[1] + p[2])) AS new_a
    FROM (
      SELECT f.*, step, bias_step, list_transform(list_zip(m, w, y), lambda q: q[2] * (1 / (1 + exp(-(list_dot_product(q[1], z) + b))) - q[3])) AS g
      FROM lr_fit f, lr_all WHERE k < {LR_STEPS}))
)""",
"""lr_last AS (SELECT a, b FROM lr_fit ORDER BY k DESC LIMIT 1)""",
"""lr_weights AS (
  SELECT x.term, sum(a[t.i] * x.weight) AS weight FROM lr_train t JOIN tfidf x ON x.id = t.id, lr_last GROUP BY x.term)""",
"""lr_scored AS (
  SELECT c.id, c.label, 1 / (1 + exp(-(b + coalesce(s, 0)))) AS p
  FROM corpus c LEFT JOIN (SELECT id, sum(x.weight * v.weight) AS s FROM tfidf x JOIN lr_weights v ON v.term = x.term GROUP BY id) q ON q.id = c.id, lr_last
  WHERE c.split = 'test')""")


def recursive(*steps: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(steps) + "\n"


TEST_METRICS = "metrics AS (" + METRICS.format(by="", source="scored", group="") + ")"

EVENTS = """ev AS (
  SELECT event_id, user_id AS run_id, CAST(floor((day(ts) - 1) / 3.0) + 1 AS INTEGER) AS epoch,
    CAST(event_type IN ('purchase', 'signup') AS INTEGER) AS label,
    1.0 / (1.0 + exp((20.0 - value) / 10.0)) AS p,
    substr(md5(CAST(event_id AS VARCHAR)), 1, 1) < 'd' AS in_train
  FROM events),
ev2 AS (
  SELECT *, CAST(p >= 0.5 AS INTEGER) AS pred,
    -ln(greatest(CASE WHEN label = 1 THEN p ELSE 1.0 - p END, 1e-15)) AS loss FROM ev)"""
RUNS = (
    EVENTS,
    "run_metrics AS ("
    + METRICS.format(by="run_id, epoch,", source="ev2", group="GROUP BY run_id, epoch")
    + ")",
    """losses AS (
  SELECT run_id, epoch, coalesce(avg(loss) FILTER (in_train), 0) AS train_loss,
    coalesce(avg(loss) FILTER (NOT in_train), 0) AS val_loss FROM ev2 GROUP BY ALL),
runs AS (SELECT * FROM losses JOIN run_metrics USING (run_id, epoch))""",
)
EPOCHS = (
    EVENTS,
    "run_metrics AS ("
    + METRICS.format(by="epoch,", source="ev2", group="GROUP BY epoch")
    + ")",
    """losses AS (
  SELECT epoch, coalesce(avg(loss) FILTER (in_train), 0) AS train_loss,
    coalesce(avg(loss) FILTER (NOT in_train), 0) AS val_loss FROM ev2 GROUP BY epoch),
epochs AS (SELECT * FROM losses JOIN run_metrics USING (epoch))""",
)
BEST = """best AS (
  SELECT run_id, epoch, f1 FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY f1 DESC, epoch) AS r FROM runs WHERE f1 > 0)
  WHERE r = 1)"""


def roc(source: str) -> tuple[str, ...]:
    return (
        f"""points AS (
  SELECT {source.split('.')[1]} AS threshold, count(*) FILTER (label = 1) AS pos,
    count(*) FILTER (label = 0) AS neg FROM {source.split('.')[0]} GROUP BY 1),
cumulative AS (
  SELECT threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
    row_number() OVER w AS i, count(*) OVER () AS k, sum(pos) OVER () AS np, sum(neg) OVER () AS nn
  FROM points WINDOW w AS (ORDER BY threshold DESC)),
bends AS (
  SELECT *, lead(tp) OVER w - 2 * tp + lag(tp) OVER w AS dtp,
    lead(fp) OVER w - 2 * fp + lag(fp) OVER w AS dfp
  FROM cumulative WINDOW w AS (ORDER BY threshold DESC)),
curve AS (
  SELECT threshold, CASE WHEN nn = 0 THEN 0 ELSE CAST(fp AS DOUBLE) / nn END AS fpr,
    CASE WHEN np = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / np END AS tpr
  FROM bends WHERE i = 1 OR i = k OR dtp <> 0 OR dfp <> 0
  UNION ALL SELECT NULL, 0.0, 0.0)""",
    )


ROC_SELECT = "SELECT round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM curve"

FORMAT = """(CASE id % 5 WHEN 0 THEN 'plain' WHEN 1 THEN 'base64' WHEN 2 THEN 'quoted'
    WHEN 3 THEN 'alternative' ELSE 'nested' END)"""
HTML_BODY = "'<html><body><p>' || body || '</p></body></html>'"
# What was composed: one row per leaf part, in order.
PARTS = f"""composed AS (SELECT *, {FORMAT} AS format FROM mails),
parts AS (
  SELECT id, format, 0 AS part_no, 'text/plain' AS content_type, CASE WHEN format = 'plain' THEN '' ELSE 'utf-8' END AS charset,
    CASE format WHEN 'base64' THEN 'base64' WHEN 'quoted' THEN 'quoted-printable' ELSE '' END AS encoding, body AS text
  FROM composed WHERE format IN ('plain', 'base64', 'quoted')
  UNION ALL SELECT id, format, CASE WHEN format = 'nested' THEN 2 ELSE 1 END, 'text/plain', 'utf-8', '', body
  FROM composed WHERE format IN ('alternative', 'nested')
  UNION ALL SELECT id, format, CASE WHEN format = 'nested' THEN 3 ELSE 2 END, 'text/html', 'utf-8', 'base64', {HTML_BODY}
  FROM composed WHERE format IN ('alternative', 'nested')
  UNION ALL SELECT id, format, 4, 'image/png', '', 'base64', NULL FROM composed WHERE format = 'nested')"""
BODIES = f"""bodies AS (
  SELECT id, coalesce(string_agg(text, ' ' ORDER BY part_no) FILTER (content_type LIKE 'text/%' AND {valid('text')}), '') AS body
  FROM parts GROUP BY id)"""

RAW_CLEANED = f"""raw_cleaned AS (
  SELECT id, subject, body, subject || ' ' || body AS full_text FROM (
    SELECT m.id, {clean('m.subject')} AS subject, {clean('b.body')} AS body FROM mails m JOIN bodies b ON m.id = b.id))"""
RAW_LANGUAGE = (
    GRAMS.replace("grams AS", "raw_grams AS").replace("lang, ", "").replace("cleaned", "raw_cleaned"),
    DETECTED.replace("scores AS", "raw_scores AS").replace("FROM scores", "FROM raw_scores")
    .replace("detected AS (", "raw_detected AS (").replace("FROM grams", "FROM raw_grams"),
)

ALL_TEXTS = """texts AS (
  SELECT 'documents' AS source, CAST(doc_id AS VARCHAR) AS id, text FROM documents
  UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR), html FROM pages
  UNION ALL SELECT 'conversations', CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR), text FROM conversations
  UNION ALL SELECT 'noisy', CAST(doc_id AS VARCHAR), text || ' ' || upper((""" + "[" + ", ".join(
    q(p) for p in NOISE_PATTERNS
) + """])[doc_id % 14 + 1]) FROM documents)"""

RULES = ", ".join(
    f"CASE WHEN contains(lower(text), {q(p)}) THEN {q(p)} END" for p in NOISE_PATTERNS
)

_SPECIAL = r"\[NO SUBJECT\]|\[NO BODY\]|\[SUBJECT\]|\[BODY\]"
PLACED_S = f"CASE WHEN {trim_ws('subject')} = '' THEN '[NO SUBJECT]' ELSE {clean('subject', 'model')} END"
PLACED_B = f"CASE WHEN {trim_ws('body')} = '' THEN '[NO BODY]' ELSE {clean('body', 'model')} END"
MODEL_TEXT = f"'[SUBJECT] ' || {PLACED_S} || ' [BODY] ' || {PLACED_B}"
MARKED = "'[SUBJECT] ' || subject || ' [BODY] ' || body"
RESERVED = ", ".join(f"({q(t)}, {i})" for i, t in enumerate(fixed.RESERVED_TOKENS))
_TOKS = f"regexp_extract_all({MODEL_TEXT}, {q(_SPECIAL + f'|[{WORD}]+|[^{WORD}{WS}]')}) AS toks"
TOKEN_IDS = f"""seqs AS (SELECT id, split, {_TOKS} FROM corpus),
reserved AS (SELECT * FROM (VALUES {RESERVED}) v(token, token_id)),
token_counts AS (
  SELECT token, count(*) AS n FROM (SELECT unnest(toks) AS token FROM seqs WHERE split = 'train')
  WHERE token NOT IN (SELECT token FROM reserved) GROUP BY token),
token_vocab AS (
  SELECT token, CAST(token_id AS INTEGER) AS token_id FROM reserved
  UNION ALL SELECT token, CAST(6 + r AS INTEGER) FROM (
    SELECT token, row_number() OVER (ORDER BY n DESC, token) AS r FROM token_counts))"""

STOPS = ", ".join(q(w) for w in STOP_WORDS)
LIME_N = 1000


#: The order in which a sample removes words: by their numbers times its factor, or by a hash of its own per word.
NUMBER_TIMES_FACTOR = """
      (('0x' || substr(md5('42:' || id || ':' || word), 1, 8))::BIGINT % 2147483648 * factor) % 2147483648, word"""
OWN_HASH = " md5('42:' || id || ':' || sample || ':' || word)"


def masks(source: str, order: str = NUMBER_TIMES_FACTOR) -> str:
    """One row per text, sample and distinct word: does the word stay?"""
    return f"""lime_words AS (
  SELECT id, list_distinct(regexp_extract_all(text, '[{WORD}]+')) AS words FROM {source}),
lime_samples AS (
  SELECT id, words, len(words) AS total, s AS sample,
    CASE WHEN s = 0 THEN 0 ELSE 1 + CAST(('0x' || substr(md5('42:' || id || ':' || s), 1, 8)) AS BIGINT) % len(words) END AS k
  FROM lime_words, (SELECT unnest(range({LIME_N})) AS s) WHERE len(words) > 0),
masks AS (
  SELECT id, sample, word, total,
    row_number() OVER (PARTITION BY id, sample ORDER BY{order}) > k AS stays
  FROM (SELECT id, sample, total, k, unnest(words) AS word,
    2 * (('0x' || substr(md5('42:' || id || ':' || sample), 9, 7))::BIGINT) + 1 AS factor FROM lime_samples))"""


CONTRIBUTIONS = """contributions AS (
  SELECT id, term, round(weight * d, 6) AS contribution FROM tfidf JOIN delta USING (term))"""
TOP = f"""ranked_features AS (
  SELECT id, term AS feature, contribution AS score,
    CAST(row_number() OVER (PARTITION BY id ORDER BY abs(contribution) DESC, term) AS INTEGER) AS rank FROM contributions),
top_features AS (
  SELECT id, feature, score, rank, CASE WHEN score > 0 THEN 'spam' ELSE 'ham' END AS direction FROM ranked_features
  WHERE rank <= 10 AND NOT contains(feature, 'SUBJECT') AND NOT contains(feature, 'BODY')
    AND trim(lower(trim(feature)), '!"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~') NOT IN ('', {STOPS}))"""


def new_scores(texts: str) -> tuple[str, ...]:
    """Score other texts (``id, text``) with the model of the corpus."""
    return (
        f"new_texts AS ({texts})",
        f"""new_lists AS (
  SELECT id, list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS t
  FROM (SELECT id, {tokens('text')} AS t FROM new_texts)),
new_weighted AS (
  SELECT id, n.term, n.tf * idf AS w FROM (
    SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM new_lists) GROUP BY ALL) n
  JOIN vocab ON n.term = vocab.term),
new_tfidf AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM new_weighted),
new_sums AS (SELECT id, sum(weight * d) AS s FROM new_tfidf JOIN delta USING (term) GROUP BY id),
new_scores AS (
  SELECT t.id, 1.0 / (1.0 + exp(-(b + coalesce(s, 0)))) AS p
  FROM new_texts t LEFT JOIN new_sums ON new_sums.id = t.id, bias)""",
    )


def decided(source: str, p: str = "p", at: float = 0.5, id_: str = "id") -> str:
    return (
        f"SELECT {id_}, CASE WHEN {p} >= {at} THEN 'spam' ELSE 'ham' END AS prediction, "
        f"round(CASE WHEN {p} >= {at} THEN {p} ELSE 1.0 - {p} END, 6) AS confidence FROM {source}"
    )


# Form encoding, in which a space is written _ and a byte =XX.
Q_SUBJECT = (
    "replace(replace(replace(replace(url_encode(subject), '%20', '_'), '%2A', '*'), '~', '%7E'), '%', '=')"
)
SERVE_CLEAN = f"{clean('subject', 'serve')} || ' ' || {clean('body', 'serve')}"

# Letters that stand for a to z in mails of twelve character sets.
CYRILLIC = "абцдефгхийклмнопярстувшыжз"
ALPHABETS = (
    CYRILLIC,
    CYRILLIC,
    "aącćdeęfghijklłmnńoóprsśtu",
    "天地人你我他上下大小中国学生老师工作时间地方朋友水火",
    "アイウエオカキクケコサシスセソタチツテトナニヌネノハ",
    "天地人你我他上下大小中國學生老師工作時間地方朋友水火",
    "אבגדהוזחטיךכלםמןנסעףפץצקרש",
    "ابتثجحخدذرزسشصضطظعغفقكلمنه",
    "กขคฆงจฉชซญฎฏฐฑฒณดตถทธนบปผฝ",
    "aābcčdeēgģiīkķlļnņsšuūzžąė",
    "abcĉdefgĝhĥijĵklmnopsŝuŭġż",
    "абвгґдеєжзиіїйклмнопрстуфх",
)


def foreign(expr: str) -> str:
    low = f"lower({sub(expr, '[^' + chr(92) + 'x00-' + chr(92) + 'x7F]', '?')})"
    arms = " ".join(f"WHEN {k} THEN translate({low}, 'abcdefghijklmnopqrstuvwxyz', '{a}')" for k, a in enumerate(ALPHABETS))
    return f"CASE id % {len(ALPHABETS)} {arms} END"


FOREIGN = f"""foreign_mails AS (
  SELECT id, id % 50 IN (7, 8) AS parse_error, {foreign('subject')} AS subject, {foreign('body')} AS body FROM mails),
read_mails AS (
  SELECT id, parse_error, CASE WHEN parse_error THEN '' ELSE subject END AS subject,
    CASE WHEN parse_error OR NOT {valid('body')} THEN '' ELSE body END AS body FROM foreign_mails)"""

ORACLES: dict[str, str] = {
    "mail_charsets": with_(MAILS, FOREIGN) + "SELECT id AS mail_id, subject, body, parse_error FROM read_mails",
    "mail_uuencode": with_(MAILS)
    + """SELECT id AS mail_id, CASE id % 4 WHEN 0 THEN 'x-uuencode' WHEN 1 THEN 'uuencode' WHEN 2 THEN 'x-uue' ELSE 'uue' END AS encoding,
  body AS text FROM mails""",
    "reject_parsed": with_(
        MAILS,
        FOREIGN,
        f"""read_cleaned AS (
  SELECT id, parse_error, subject, body, subject || ' ' || body AS full_text FROM (
    SELECT id, parse_error, {clean('subject')} AS subject, {clean('body')} AS body FROM read_mails))""",
    )
    + f"""SELECT CAST(id % 6 AS INTEGER) AS charset_no, CASE WHEN parse_error THEN 'parse_error' WHEN {BLANK} THEN 'blank'
  WHEN {noise('full_text')} THEN 'noise' WHEN length({trim_ws('full_text')}) < 10 THEN 'short' ELSE 'accepted' END AS reason,
  count(*) AS mails FROM read_cleaned GROUP BY ALL""",
    # sources and sinks
    "scan_mail_csv": with_(MAILS)
    + f"""SELECT 'mail/' || id AS file, md5('Subject: ' || subject || {NL} || {NL} || body) AS digest,
  CAST(length('Subject: ' || subject || {NL} || {NL} || body) AS INTEGER) AS chars FROM mails""",
    "scan_mail_files": f"""SELECT item_id, 'item' AS subject,
  CASE WHEN {valid('text')} THEN rtrim(text) ELSE '' END AS body FROM benchmark""",
    "split_round_trip": with_(*CORPUS)
    + "SELECT id, subject, body, label, split FROM corpus",
    "split_csv_round_trip": with_(*CORPUS)
    + "SELECT id, subject, body, label, split FROM corpus",
    "model_round_trip": with_(*TEST) + "SELECT id, round(p, 6) AS spam_prob, true AS same_scores, 'corpus' AS profile, true AS same_priors FROM scored",
    "prediction_history": with_(*MODEL, scored("split IN ('validate', 'test')")) + decided("scored"),
    "history_csv": with_(*EPOCHS)
    + f"SELECT epoch, round(train_loss, 6) AS train_loss, round(val_loss, 6) AS val_loss, {ROUNDED} FROM epochs",
    "run_params": with_(*EPOCHS)
    + """SELECT 'events' AS run_id, 'naive_bayes' AS model_name, 512 AS max_length, 16 AS batch_size,
  CAST(0.00002 AS DOUBLE) AS learning_rate, 10 AS num_epochs, 100 AS warmup_steps, CAST(0.01 AS DOUBLE) AS weight_decay,
  4 AS gradient_accumulation_steps, 3 AS patience, round(f1, 6) AS best_f1, epoch AS best_epoch
FROM epochs WHERE f1 > 0 ORDER BY f1 DESC, epoch LIMIT 1""",
    "resolve_model": with_(*RUNS, BEST)
    + """SELECT l.run_id AS user_id, coalesce(b.epoch, l.epoch) AS epoch,
  CASE WHEN b.epoch IS NULL THEN 'latest' ELSE 'best' END AS alias, round(coalesce(b.f1, l.f1), 6) AS f1
FROM (SELECT run_id, max(epoch) AS epoch, max_by(f1, epoch) AS f1 FROM runs GROUP BY run_id) l
LEFT JOIN best b USING (run_id)""",
    # mail decoding
    "mail_subject": with_(MAILS)
    + f"SELECT id AS mail_id, {FORMAT} AS format, trim(subject) AS subject, false AS parse_error FROM mails",
    "mail_parts": with_(MAILS, PARTS)
    + "SELECT id AS mail_id, part_no, content_type, charset, encoding FROM parts",
    "part_decode": with_(MAILS, PARTS)
    + "SELECT id AS mail_id, part_no, text FROM parts WHERE content_type LIKE 'text/%'",
    "mail_body": with_(MAILS, PARTS, BODIES)
    + "SELECT id AS mail_id, body, false AS parse_error FROM bodies",
    "mail_body_serve": with_(MAILS)
    + "SELECT id AS mail_id, body, false AS parse_error FROM mails",
    "corpus_from_raw": with_(
        *LANGUAGE,
        PARTS,
        BODIES,
        RAW_CLEANED,
        *RAW_LANGUAGE,
        split_of(
            f"""SELECT c.id, subject, body, CAST(l.toxic AS INTEGER) AS label FROM raw_cleaned c
      JOIN labels l ON c.id = l.doc_id JOIN raw_detected d ON c.id = d.id
      WHERE NOT {BLANK} AND {valid('full_text')} AND d.detected = 'en'"""
        ),
    )
    + "SELECT id, subject, label, split, md5(body) AS digest FROM corpus",
    # text
    **{
        f"clean_{p}": with_(MAILS)
        + f"SELECT id, {clean('subject', p)} AS subject, {clean('body', p)} AS body FROM mails"
        for p in ("corpus", "serve", "model")
    },
    "html_pages": f"SELECT page_id, {html('html')} AS text FROM pages",
    "clean_pages": f"""SELECT page_id, {clean('html')} AS corpus, {clean('html', 'serve')} AS serve,
  {clean("'see ' || url || ' or mail me@host.org'")} AS link_corpus,
  {clean("'see ' || url || ' or mail me@host.org'", 'serve')} AS link_serve FROM pages""",
    "marked_texts": with_(MAILS)
    + f"""SELECT id, {MODEL_TEXT} AS model_text, {MARKED} AS marked, subject || ' ' || body AS plain FROM mails""",
    # gates
    "noise_rules": with_(ALL_TEXTS)
    + f"SELECT source, id, concat_ws(',', {RULES}) AS rules FROM texts",
    "valid_content": with_(ALL_TEXTS)
    + f"""SELECT source, id, CAST({valid('text')} AS INTEGER) AS raw_valid,
  CAST({valid('cleaned')} AS INTEGER) AS clean_valid
FROM (SELECT *, {clean('text')} AS cleaned FROM texts)""",
    "language_round_trip": with_(
        f"""items AS (SELECT item_id, left(CAST(item_id AS VARCHAR), 1) AS lang, string_split(text, '') AS c,
    string_split(substr(text, 1, 1000), '') AS head FROM benchmark WHERE length(text) > 2),
item_counts AS (SELECT lang, gram, count(*) AS n FROM (SELECT lang, unnest({_GRAM_LIST}) AS gram FROM items) GROUP BY ALL),
item_sizes AS (SELECT lang, sum(n) + (SELECT count(DISTINCT gram) FROM item_counts) AS size FROM item_counts GROUP BY lang),
item_scores AS (
  SELECT g.item_id, s.lang, round(sum(ln(coalesce(p.n, 0) + 1) - ln(s.size)), 6) AS score
  FROM (SELECT item_id, unnest({_GRAM_LIST}) AS gram FROM (SELECT item_id, head AS c FROM items)) g
  JOIN (SELECT DISTINCT gram FROM item_counts) k ON k.gram = g.gram
  CROSS JOIN item_sizes s LEFT JOIN item_counts p ON p.gram = g.gram AND p.lang = s.lang GROUP BY ALL)"""
    )
    + """SELECT b.item_id, detected, confidence FROM benchmark b LEFT JOIN (
  SELECT item_id, arg_min(lang, (-score, lang)) AS detected, round(1 / sum(exp(score - best)), 6) AS confidence
  FROM (SELECT *, max(score) OVER (PARTITION BY item_id) AS best FROM item_scores) GROUP BY item_id) USING (item_id)""",
    "lang_id": with_(*LANGUAGE) + "SELECT id, lang, detected FROM judged",
    "accepted_mails": with_(*LANGUAGE)
    + "SELECT id, subject, CAST(length(body) AS INTEGER) AS chars FROM judged WHERE reason = 'accepted'",
    "reject_report": with_(*LANGUAGE)
    + "SELECT lang, reason, count(*) AS mails FROM judged GROUP BY ALL",
    # corpus
    "union_corpus": """SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, text, 0 AS label FROM documents
UNION ALL SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR), text, 1 FROM conversations""",
    "first_n": with_(*KEPT) + "SELECT id, subject FROM kept ORDER BY id LIMIT 300",
    "sample_n": with_(*KEPT) + f"SELECT id, subject FROM kept ORDER BY {key('id')}, id LIMIT 300",
    "shuffle_order": f"""SELECT doc_id AS id, row_number() OVER (ORDER BY {key('doc_id')}, doc_id) AS position FROM documents""",
    "exact_split": with_(*CORPUS) + "SELECT id, label, split FROM corpus",
    "split_summary": with_(*CORPUS)
    + """SELECT coalesce(split, 'all') AS split, CAST(coalesce(label, -1) AS INTEGER) AS label, count(*) AS mails
FROM corpus GROUP BY ROLLUP (split, label)""",
    # features
    "tokens": with_(MAILS)
    + f"""SELECT id, array_to_string(t, ' ') AS tokens, CAST(len(t) AS INTEGER) AS n
FROM (SELECT id, {tokens("subject || ' ' || body")} AS t FROM mails)""",
    "ngrams": with_(MAILS)
    + f"""SELECT id, array_to_string(t, '|') AS terms, CAST(len(t) AS INTEGER) AS n FROM (
  SELECT id, list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS t
  FROM (SELECT id, {tokens("subject || ' ' || body")} AS t FROM mails))""",
    "vocab": with_(*CORPUS, TERMS, VOCAB)
    + "SELECT term, df, total, round(idf, 6) AS idf FROM vocab",
    "vocab_filtered": with_(*CORPUS, TERMS, VOCAB.replace(" WHERE split = 'train'", ""))
    + "SELECT term, df, total, round(idf, 6) AS idf FROM vocab",
    "tf": with_(*KEPT, "corpus AS (SELECT *, 0 AS label, 'all' AS split FROM kept)", TERMS) + "SELECT id, term, tf FROM tf",
    "tfidf": with_(*CORPUS, TERMS, VOCAB, TFIDF)
    + "SELECT id, term, round(weight, 6) AS weight FROM tfidf WHERE split = 'train'",
    "tfidf_apply": with_(*CORPUS, TERMS, VOCAB, TFIDF)
    + "SELECT id, term, round(weight, 6) AS weight FROM tfidf",
    "token_vocab": with_(*CORPUS, TOKEN_IDS) + "SELECT token, token_id FROM token_vocab",
    "encode_ids": with_(*CORPUS, TOKEN_IDS)
    + f", all_seqs AS (SELECT id, {_TOKS} FROM judged WHERE reason = 'accepted')"
    + """, placed AS (
  SELECT s.id, s.pos, coalesce(v.token_id, 1) AS token_id
  FROM (SELECT id, unnest(toks[1:510]) AS token, generate_subscripts(toks[1:510], 1) AS pos FROM all_seqs) s
  LEFT JOIN token_vocab v ON v.token = s.token),
used AS (
  SELECT id, list_concat(list_concat([2], list(token_id ORDER BY pos)), [3]) AS ids FROM placed GROUP BY id)
SELECT id,
  array_to_string(list_concat(ids, list_transform(range(512 - len(ids)), lambda i: 0)), ' ') AS input_ids,
  array_to_string(list_concat(list_transform(ids, lambda x: 1), list_transform(range(512 - len(ids)), lambda i: 0)), ' ') AS attention_mask
FROM used""".lstrip(),
    "no_stop": with_(MAILS)
    + f"""SELECT word, count(*) AS n FROM (SELECT unnest({tokens("subject || ' ' || body")}) AS word FROM mails)
WHERE word NOT IN ({STOPS}) GROUP BY word""",
    # models
    "class_weights": with_(*CORPUS)
    + """SELECT label, mails, round(CAST(sum(mails) OVER () AS DOUBLE) / (count(*) OVER () * mails), 6) AS weight
FROM (SELECT label, count(*) AS mails FROM corpus WHERE split = 'train' GROUP BY label)""",
    "nb_fit": with_(*MODEL)
    + """SELECT t.label, term, round(t.lp, 6) AS log_likelihood, round(p.lp, 6) AS log_prior
FROM theta t JOIN prior p ON t.label = p.label""",
    "nb_score": with_(*TEST) + "SELECT id, label, round(spam_prob, 6) AS spam_prob, pred FROM scored",
    "score_batch": with_(
        *MODEL,
        *new_scores(
            f"""SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS id, {clean('text')} AS text
  FROM conversations"""
        ),
    )
    + decided("new_scores"),
    "score_serve": with_(
        *MODEL,
        # The serving parser takes the subject as it stands in the header, encoded words and all.
        f"""served AS (
  SELECT id, body, CASE WHEN id % 5 = 1 THEN '=?UTF-8?Q?' || {Q_SUBJECT} || '?='
    WHEN id % 5 = 4 THEN '=?utf-8?B?' || to_base64(encode(subject)) || '?=' ELSE subject END AS subject FROM mails)""",
        *new_scores(f"SELECT id, {SERVE_CLEAN} AS text FROM served"),
    )
    + """SELECT id AS mail_id, CASE WHEN p >= 0.3 THEN 'spam' ELSE 'ham' END AS prediction,
  round(p, 6) AS spam_prob FROM new_scores""",
    "decide": with_(*TEST) + decided("scored", "spam_prob", 0.2),
    "softmax": """WITH z AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS z FROM embeddings),
e AS (SELECT vec_id, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM z),
p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)
SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS top_class,
  round(list_max(p), 6) AS top_prob, round(p[1], 6) AS first_prob FROM p""",
    "log_loss": with_(
        *TEST,
        """losses AS (
  SELECT -ln(greatest(CASE WHEN label = 1 THEN spam_prob ELSE 1.0 - spam_prob END, 1e-15)) AS loss,
    row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), id) AS r FROM scored)""",
    )
    + """SELECT 'mails' AS mean_over, round(avg(loss), 6) AS log_loss FROM losses
UNION ALL SELECT 'batches', round(avg(m), 6) FROM (
  SELECT avg(loss) AS m FROM losses GROUP BY floor((r - 1) / 16.0))""",
    "custom_scorer": with_(MAILS)
    + """SELECT id, round(CAST(length(t) - length(replace(t, '!', '')) AS DOUBLE) / length(t), 6) AS spam_prob
FROM (SELECT id, subject || ' ' || body AS t FROM mails)""",
    # evaluation
    "binary_metrics": with_(*TEST, TEST_METRICS) + f"SELECT {ROUNDED} FROM metrics",
    "metrics_report": with_(*TEST, TEST_METRICS)
    + """SELECT metric, round(value, 6) AS value, printf('%.1f%%', value * 100) AS shown FROM (
  SELECT 'Accuracy' AS metric, accuracy AS value FROM metrics
  UNION ALL SELECT 'Precision', "precision" FROM metrics
  UNION ALL SELECT 'Recall', recall FROM metrics UNION ALL SELECT 'F1 Score', f1 FROM metrics)""",
    "confusion": with_(*TEST)
    + """SELECT label, count(*) FILTER (s.pred = 0) AS pred_0, count(*) FILTER (s.pred = 1) AS pred_1
FROM (VALUES (0), (1)) v(label) LEFT JOIN scored s USING (label) GROUP BY label""",
    "confusion_norm": with_(*TEST)
    + """SELECT label, round(avg(1.0 - pred), 6) AS pred_0, round(avg(CAST(pred AS DOUBLE)), 6) AS pred_1
FROM scored GROUP BY label""",
    "roc_curve": with_(*TEST, *roc("scored.spam_prob")) + ROC_SELECT,
    "roc_events": with_(EVENTS, *roc("ev.p")) + ROC_SELECT,
    "roc_auc": with_(*TEST, *roc("scored.spam_prob"))
    + """SELECT round(coalesce(sum((fpr - prev_fpr) * (tpr + prev_tpr) / 2), 0), 6) AS auc FROM (
  SELECT fpr, tpr, lag(fpr) OVER w AS prev_fpr, lag(tpr) OVER w AS prev_tpr FROM curve WINDOW w AS (ORDER BY fpr, tpr))""",
    "epoch_history": with_(*RUNS)
    + f"""SELECT run_id, epoch, round(train_loss, 6) AS train_loss, round(val_loss, 6) AS val_loss, {ROUNDED} FROM runs""",
    "best_epoch": with_(*RUNS, BEST) + "SELECT run_id, epoch, round(f1, 6) AS f1 FROM best",
    "early_stop": with_(
        *RUNS,
        """gains AS (
  SELECT run_id, epoch, f1 > coalesce(max(f1) OVER (PARTITION BY run_id ORDER BY epoch
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gain FROM runs),
last_gains AS (
  SELECT a.run_id, a.epoch, coalesce(max(b.epoch), 0) AS last_gain FROM gains a
  LEFT JOIN gains b ON b.run_id = a.run_id AND b.epoch <= a.epoch AND b.gain GROUP BY ALL),
stops AS (SELECT run_id, min(epoch) AS stop_epoch FROM last_gains WHERE epoch - last_gain >= 3 GROUP BY run_id)""",
    )
    + """SELECT l.run_id, CAST(max(last_gain) AS INTEGER) AS best_epoch, CAST(min(stop_epoch) AS INTEGER) AS stop_epoch
FROM last_gains l LEFT JOIN stops s ON s.run_id = l.run_id
WHERE s.stop_epoch IS NULL OR l.epoch <= s.stop_epoch GROUP BY l.run_id""",
    # explanation
    "lime_weights": with_(*CORPUS, f"""removals AS (
  SELECT id, total, s AS sample, total - CASE WHEN s = 0 THEN 0 ELSE
    1 + CAST(('0x' || substr(md5('42:' || id || ':' || s), 1, 8)) AS BIGINT) % total END AS kept
  FROM (SELECT id, len(list_distinct(regexp_extract_all({MARKED}, '[{WORD}]+'))) AS total FROM corpus),
    (SELECT unnest(range({LIME_N})) AS s) WHERE total > 0)""")
    + """SELECT id, CAST(sample AS INTEGER) AS sample, CAST(kept AS INTEGER) AS kept, CAST(total AS INTEGER) AS total,
  round(sqrt(exp(-pow(100 * (1 - sqrt(CAST(kept AS DOUBLE) / total)), 2) / 625)), 6) AS weight FROM removals""",
    "lime_masks": with_("items AS (SELECT item_id AS id, text FROM benchmark)", masks("items", OWN_HASH))
    + "SELECT id, word, count(*) FILTER (stays) AS kept FROM masks GROUP BY ALL",
    "lime_scores": with_(
        *MODEL,
        "items AS (SELECT item_id AS id, text FROM benchmark)",
        masks("items"),
        f"""in_order AS (
  SELECT id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT id, regexp_extract_all(text, '[{WORD}]+') AS w FROM items)),
kept_words AS (SELECT id, sample, count(*) FILTER (stays) AS kept FROM masks GROUP BY ALL)""",
        *new_scores(
            """SELECT id || ':' || sample AS id, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (stays), '') AS text
  FROM masks JOIN in_order USING (id, word) GROUP BY masks.id, sample"""
        ),
    )
    + """SELECT k.id, CAST(sample AS INTEGER) AS sample, CAST(kept AS INTEGER) AS kept, round(p, 6) AS spam_prob
FROM kept_words k JOIN new_scores s ON s.id = k.id || ':' || sample""",
    "nb_contributions": with_(*MODEL, CONTRIBUTIONS) + "SELECT * FROM contributions",
    "top_features": with_(*MODEL, CONTRIBUTIONS, TOP) + "SELECT * FROM top_features",
    "explain_status": with_(*MODEL, CONTRIBUTIONS, TOP)
    + f"""SELECT c.id, CASE WHEN {trim_ws("subject || ' ' || body")} = '' THEN 'empty_text' WHEN n IS NULL THEN 'no_features' ELSE 'ok' END AS status,
  coalesce(n, 0) AS features FROM corpus c
LEFT JOIN (SELECT id, count(*) AS n FROM top_features GROUP BY id) f ON f.id = c.id""",
    "explain_orders": with_(*MODEL, CONTRIBUTIONS, TOP)
    + """SELECT id, feature, CAST(row_number() OVER (PARTITION BY id ORDER BY abs(score), feature) AS INTEGER) AS plot_place,
  CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, feature) AS INTEGER) AS table_place FROM top_features""",
    "lime_settled": with_(*CORPUS)
    + f"""SELECT id, least(len(list_distinct(regexp_extract_all({MARKED}, '[{WORD}]+'))), 10) AS features, true AS settled
FROM corpus""",
    "lr_score": recursive(*MODEL, *LOGISTIC)
    + "SELECT id, label, round(p, 3) AS spam_prob, CAST(p > 0.5 AS INTEGER) AS pred FROM lr_scored",
    "model_compare": recursive(
        *MODEL,
        *LOGISTIC,
        scored("split = 'test'"),
        """compared AS (
  SELECT 'naive_bayes' AS model, label, round(p, 9) AS p, CAST(p > 0.5 AS INTEGER) AS pred FROM scored
  UNION ALL SELECT 'logistic_regression', label, round(p, 9), CAST(p > 0.5 AS INTEGER) FROM lr_scored)""",
        "metrics AS (" + METRICS.format(by="model,", source="compared", group="GROUP BY model") + ")",
        """areas AS (
  SELECT a.model, sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) / count(*) AS auc
  FROM compared a JOIN compared b ON a.model = b.model AND a.label = 1 AND b.label = 0 GROUP BY a.model)""",
    )
    + f"SELECT model, {ROUNDED}, round(auc, 6) AS auc FROM metrics JOIN areas USING (model)",
    "lr_settled": with_(*CORPUS, TERMS, VOCAB)
    + "SELECT term, true AS settled FROM vocab UNION ALL SELECT '(intercept)', true",
    "lr_agrees": with_(*CORPUS) + "SELECT id, label, true AS agrees FROM corpus WHERE split = 'test'",
    # files
    **{
        name: with_(*MODEL, *new_scores(f"""SELECT item_id AS id, 'win ' || {clean('text')} AS text FROM benchmark"""))
        + """SELECT id AS item_id, CASE WHEN p >= 0.5 THEN 'spam' ELSE 'ham' END AS prediction,
  round(p, 6) AS spam_prob FROM new_scores"""
        for name in ("score_files", "stream_file_scores")
    },
    "prepared_corpus": with_(
        *LANGUAGE,
        f"bodies AS (SELECT id, CASE WHEN {valid('body')} THEN body ELSE '' END AS body FROM mails)",
        RAW_CLEANED,
        *RAW_LANGUAGE,
        f"""passed AS (
  SELECT c.id, subject, body, CAST(l.toxic AS INTEGER) AS label FROM raw_cleaned c
  JOIN labels l ON c.id = l.doc_id JOIN raw_detected d ON c.id = d.id
  WHERE NOT {BLANK} AND {valid('full_text')} AND d.detected = 'en')""",
        split_of(
            f"""SELECT id, subject, body, label FROM (
        SELECT *, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN label = 0 THEN lpad(CAST(id AS VARCHAR), 20, '0')
          ELSE {key('id')} END, id) AS place FROM passed) WHERE place <= 5000"""
        ),
    )
    + "SELECT id, subject, label, split, md5(body) AS digest FROM corpus",
    "model_registry": with_(*EPOCHS)
    + """SELECT row_number() OVER (ORDER BY epoch) AS version, CAST(epoch AS VARCHAR) AS run_id, round(f1, 6) AS f1,
  CASE WHEN b AND l THEN 'best latest' WHEN b THEN 'best' WHEN l THEN 'latest' END AS aliases,
  CASE WHEN any_best THEN b ELSE l END AS chosen
FROM (SELECT *, bool_or(b) OVER () AS any_best FROM (
  SELECT epoch, f1, f1 > 0 AND row_number() OVER (ORDER BY f1 DESC, epoch) = 1 AS b, row_number() OVER (ORDER BY epoch DESC) = 1 AS l
  FROM epochs))""",
    # streaming
    "mixed_history": with_(*MODEL, scored("split IN ('train', 'validate', 'test')")) + decided("scored"),
    "stream_scores": with_(*MODEL, scored("split IN ('train', 'validate', 'test')")) + decided("scored"),
    # flagship
    "train_and_evaluate": with_(*TEST, TEST_METRICS) + f"SELECT {ROUNDED} FROM metrics",
}
