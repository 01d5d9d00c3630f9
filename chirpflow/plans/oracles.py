"""Independent SQL oracles (DuckDB dialect) for the registered queries.

Written from the specification, not from the Spark plans, and where possible by
a different route: token counting instead of look-around regexes, recursive
CTEs instead of pointer jumping, concatenate-then-split instead of per-tweet
counts, sparse joins instead of dense vector maths. The driver tables are
pre-registered views; the CTEs below shape them like ``sources.fixtures``.
"""

from __future__ import annotations

# --- Fixed values: patterns shared with chirpflow.functions.text (RE2 syntax) ---
TOKEN = r"[\p{L}\p{N}_]+"
# the standard analyzer's words in scripts written with spaces (RE2 has no class difference)
_LETTER = r"[\p{Latin}\p{Greek}\p{Cyrillic}\p{Armenian}\p{Hebrew}\p{Arabic}\p{Devanagari}\p{Hangul}][\p{Latin}\p{Greek}\p{Cyrillic}\p{Armenian}\p{Hebrew}\p{Arabic}\p{Devanagari}\p{Hangul}\p{M}]*"
_LETTERS = rf"{_LETTER}(?:['’.:·]{_LETTER})*"
_DIGITS = r"\p{Nd}[\p{Nd}\p{M}]*(?:['’.,;]\p{Nd}[\p{Nd}\p{M}]*)*"
_WORD = rf"(?:{_LETTERS}|{_DIGITS})+"
STANDARD = rf"_*{_WORD}(?:_+{_WORD})*_*|[\p{{Han}}\p{{Hiragana}}]\p{{M}}*|[\p{{Katakana}}ー]+|\p{{Thai}}+".replace("'", "''")
# --- end of fixed values ---

POSTS = """
posts as (
  select cast(d.doc_id as varchar) as tweet_id, cast(o.o_custkey as varchar) as account_id,
         o.o_orderdate as created_at, d.text as full_text,
         cast(d.n_chars % 100 as integer) as retweet_count, cast(d.n_chars % 37 as integer) as favorite_count,
         cast(null as varchar) as reply_to_tweet_id, cast(null as varchar) as reply_to_user_id,
         cast(null as varchar) as reply_to_username, d.source as username, d.lang as lang
  from documents d join orders o on d.doc_id = o.o_orderkey
)"""

TOP_WORDS = f"""
month_tokens as (
  select strftime(created_at, '%Y-%m') as month, tweet_id,
         unnest(regexp_extract_all(lower(full_text), '{STANDARD}')) as word
  from posts where created_at is not null and full_text is not null
),
month_counts as (
  select month, word, count(distinct tweet_id) as doc_count from month_tokens group by month, word
),
top as (
  select month, word, doc_count,
         cast(row_number() over (partition by month order by doc_count desc, word) as integer) as rank
  from month_counts qualify rank <= 1000
)"""

ORACLES: dict[str, str] = {}

ORACLES["daily_word_count"] = f"""
with {POSTS},
toks as (
  select cast(created_at as date) as day, unnest(regexp_extract_all(lower(full_text), '{TOKEN}')) as tok
  from posts where full_text is not null and created_at is not null
),
hits as (select day, count(*) as n from toks where tok = 'the' group by day),
days as (select distinct cast(created_at as date) as day from posts
         where full_text is not null and created_at is not null)
select days.day, cast(coalesce(hits.n, 0) as bigint) as matches from days left join hits on hits.day = days.day
"""

ORACLES["doc_term_counts"] = f"""
with {POSTS}
select doc_id, term, count(*) as tf from (
  select tweet_id as doc_id, unnest(regexp_extract_all(lower(full_text), '{TOKEN}')) as term
  from posts where full_text is not null and created_at is not null
) group by doc_id, term
"""

ORACLES["term_totals"] = f"""
with {POSTS}
select day, term, count(*) as n from (
  select cast(created_at as date) as day, unnest(regexp_extract_all(lower(full_text), '{TOKEN}')) as term
  from posts where full_text is not null and created_at is not null
) group by day, term
"""

ORACLES["term_totals_timestamp"] = f"""
with {POSTS}
select created_at, term, count(*) as n from (
  select cast(created_at as timestamp) as created_at, unnest(regexp_extract_all(lower(full_text), '{TOKEN}')) as term
  from posts where full_text is not null and created_at is not null
) group by created_at, term
"""

ORACLES["term_series"] = f"""
with {POSTS},
per_post as (
  select cast(created_at as date) as day,
         len(list_filter(regexp_extract_all(lower(full_text), '{TOKEN}'), lambda t: t = 'the')) as hits
  from posts where full_text is not null and created_at is not null
)
select day, 'the' as term, cast(sum(hits) as bigint) as n from per_post group by day
"""

ORACLES["vocabulary"] = f"""
with {POSTS}
select distinct unnest(regexp_extract_all(lower(full_text), '{TOKEN}')) as term
from posts where full_text is not null and created_at is not null
"""

ORACLES["monthly_posts"] = f"""
with {POSTS},
m as (select date_trunc('month', created_at) as m, count(*) as n from posts
      where created_at is not null group by 1),
cal as (select unnest(generate_series((select min(m) from m), (select max(m) from m), interval 1 month)) as m)
select strftime(cal.m, '%Y-%m') as month, cast(coalesce(m.n, 0) as bigint) as n_posts
from cal left join m on m.m = cal.m
"""

ORACLES["monthly_top_words"] = f"""
with {POSTS}, {TOP_WORDS}
select month, word, doc_count, rank from top
"""

ORACLES["word_spikes"] = f"""
with {POSTS}, {TOP_WORDS},
pairs as (  -- complete monthly counts, not the top lists
  select c.month, c.word, c.doc_count as cur_count,
         coalesce((select p.doc_count from month_counts p
                   where p.word = c.word
                     and p.month = strftime(cast(c.month || '-01' as date) - interval 1 month, '%Y-%m')), 0)
           as prev_count
  from month_counts c
)
select month, word, cast(prev_count as bigint) as prev_count, cast(cur_count as bigint) as cur_count,
       round(cur_count / prev_count, 2) as ratio
from pairs where prev_count > 0 and cur_count >= prev_count * 5
"""

ARCHIVE = """
arch_base as (
  select c.conv_id, c.turn, c.role, c.text, o.o_orderdate, c.turn as pos
  from conversations c left join orders o on o.o_orderkey = c.conv_id
  union all
  select c.conv_id, c.turn, c.role, c.text || ' (edited)', o.o_orderdate, c.turn + 100
  from conversations c left join orders o on o.o_orderkey = c.conv_id
  where c.role = 'assistant' and c.turn = 1
),
archive as (
  select cast(conv_id as varchar) as account_id, cast(pos as bigint) as pos, role = 'system' as retweeted,
         cast(conv_id * 100 + turn as varchar) as id, text as full_text,
         case when conv_id % 10 = 3 then ''
              when conv_id % 10 = 7 then strftime(o_orderdate, '%b %Y')
              else strftime(o_orderdate + to_days(cast(turn as integer)), '%a %b %d %H:%M:%S +0000 %Y')
         end as created_at,
         case when turn % 3 <> 0 then (case when turn = 4 then 'other' else cast(conv_id as varchar) end)
         end as in_reply_to_user_id,
         case when turn % 3 <> 0 then cast(case when turn = 1 and conv_id % 2 = 0 then conv_id * 100 + 99
                                                else conv_id * 100 + turn - 1 end as varchar)
         end as in_reply_to_status_id
  from arch_base
),
tw as (select * from archive where not retweeted),
ids as (select distinct account_id, id from tw),
last_reply as (
  select account_id, id, in_reply_to_status_id as parent,
         row_number() over (partition by account_id, id order by pos desc) as rn
  from tw where in_reply_to_user_id = account_id
)"""


def _roots_sql(in_archive: bool) -> str:
    keep = (
        "and exists (select 1 from ids i where i.account_id = l.account_id and i.id = l.parent)"
        if in_archive else ""
    )
    return f"""
edges as (select account_id, id, parent from last_reply l where rn = 1 and parent is not null {keep}),
walk(account_id, id, cur, depth) as (
  select account_id, id, id, 0 from ids
  union all
  select w.account_id, w.id, e.parent, w.depth + 1
  from walk w join edges e on e.account_id = w.account_id and e.id = w.cur
),
roots as (select account_id, id, arg_max(cur, depth) as root_id, false as is_cycle from walk group by account_id, id)"""


ORACLES["dedup_last"] = f"""
with {ARCHIVE}
select account_id, id, pos, full_text from (
  select *, row_number() over (partition by account_id, id order by pos desc) as rn from tw
) where rn = 1
"""

ORACLES["thread_roots_in_archive"] = f"""
with recursive {ARCHIVE}, {_roots_sql(True)}
select * from roots
"""

ORACLES["thread_roots_dangling"] = f"""
with recursive {ARCHIVE}, {_roots_sql(False)}
select * from roots
"""

ORACLES["thread_text"] = f"""
with recursive {ARCHIVE}, {_roots_sql(True)}
select r.account_id, r.root_id, string_agg(t.full_text, ' ' order by t.pos) as text, count(*) as n_posts
from tw t join roots r on r.account_id = t.account_id and r.id = t.id
group by r.account_id, r.root_id
"""

_DATED = """
dated as (
  select r.account_id, r.root_id, t.full_text,
         row_number() over (partition by r.account_id, r.root_id
                            order by try_strptime(substr(t.created_at, 5), '%b %d %H:%M:%S %z %Y') asc nulls last, t.pos) as n
  from tw t join roots r on r.account_id = t.account_id and r.id = t.id
)"""

ORACLES["thread_parts"] = f"""
with recursive {ARCHIVE}, {_roots_sql(True)}, {_DATED}
select account_id, root_id, cast((n - 1) // 3 as bigint) as part, string_agg(full_text, ' ' order by n) as text, count(*) as n_posts
from dated group by account_id, root_id, (n - 1) // 3
"""

ORACLES["thread_text_by_date"] = f"""
with recursive {ARCHIVE}, {_roots_sql(True)}, {_DATED}
select account_id, root_id, string_agg(full_text, ' ' order by n) as text, count(*) as n_posts
from dated group by account_id, root_id
"""

THREAD_WORDS = f"""
threads as (
  select r.account_id, r.root_id, string_agg(t.full_text, ' ' order by t.pos) as text
  from tw t join roots r on r.account_id = t.account_id and r.id = t.id
  group by r.account_id, r.root_id
),
root_tweet as (
  select account_id, id, created_at from (
    select *, row_number() over (partition by account_id, id order by pos desc) as rn from tw) where rn = 1
),
dated as (
  select th.text, list_filter(regexp_split_to_array(trim(rt.created_at), '\\s+'), lambda x: x <> '') as parts
  from threads th join root_tweet rt on rt.account_id = th.account_id and rt.id = th.root_id
  where rt.created_at is not null and rt.created_at <> ''
),
keyed as (
  select text, case when len(parts) < 6 then 'UnknownDate' else parts[2] || parts[3] || parts[6] end as date_key
  from dated
),
words as (
  select date_key,
         unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text), 'http\\S+|[^a-z\\s]', '', 'g'), '\\s+'),
                            lambda x: x <> '')) as word
  from keyed
),
counts as (
  select word, date_key, cast(try_strptime(date_key, '%b%d%Y') as date) as date, count(*) as n
  from words where word not in ('the', 'and', 'of', 'in', 'to', 'a', 'is', 'on', 'that', 'don''t')
  group by word, date_key
)"""

ORACLES["thread_word_by_date"] = f"""
with recursive {ARCHIVE}, {_roots_sql(True)}, {THREAD_WORDS}
select * from counts
"""

ORACLES["word_series"] = f"""
with recursive {ARCHIVE}, {_roots_sql(True)}, {THREAD_WORDS}
select date, cast(sum(n) as bigint) as n from counts where word = 'ertion' and date is not null group by date
"""

# ---- vectors and search ------------------------------------------------------

VECS = """
vecs as (select vec_id, cast(embedding as double[]) as emb, label from embeddings),
cells as (
  select label, i, avg(v) as m
  from (select label, unnest(emb) as v, generate_subscripts(emb, 1) as i from vecs)
  group by label, i
),
cent as (select label as query_id, list(m order by i) as qv from cells group by label),
corpus as (
  select p.*, cast(e.embedding as double[]) as emb
  from posts p join embeddings e on cast(p.tweet_id as bigint) = e.vec_id
)"""

RESULT_COLS = """
  h.query_id, cast(h.rank as integer) as rank, round(h.score, 6) as score, c.username,
  strftime(c.created_at, '%Y-%m-%d') as date, c.retweet_count, c.favorite_count,
  case when length(c.full_text) > 150 then left(c.full_text, 150) || '...' else c.full_text end as snippet,
  c.tweet_id"""

ORACLES["cosine_topk"] = f"""
with {VECS},
mean as (
  select 0 as query_id, list(m order by i) as qv from (
    select i, avg(v) as m from (select unnest(emb) as v, generate_subscripts(emb, 1) as i from vecs) group by i)
),
s as (select q.query_id, v.vec_id, list_cosine_similarity(v.emb, q.qv) as score from vecs v, mean q),
r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, round(score, 6) as score from r where rank <= 10
"""

ORACLES["cosine_topk_batch"] = f"""
with {VECS},
s as (select q.query_id, v.vec_id, list_cosine_similarity(v.emb, q.qv) as score from vecs v, cent q),
r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, round(score, 6) as score from r where rank <= 10
"""

ORACLES["knn_search"] = f"""
with {POSTS}, {VECS},
s as (select q.query_id, c.tweet_id, 1.0 / (1.0 + pow(list_distance(c.emb, q.qv), 2)) as score from corpus c, cent q),
h as (select *, row_number() over (partition by query_id order by round(score, 9) desc, tweet_id) as rank from s)
select {RESULT_COLS}
from h join posts c on c.tweet_id = h.tweet_id where h.rank <= 5
"""

ORACLES["knn_by_date"] = f"""
with {POSTS}, {VECS},
s as (select q.query_id, c.tweet_id, 1.0 / (1.0 + pow(list_distance(c.emb, q.qv), 2)) as score from corpus c, cent q),
k as (select * from (
        select *, row_number() over (partition by query_id order by round(score, 9) desc, tweet_id) as krank from s)
      where krank <= 10),
h as (select k.query_id, k.tweet_id, k.score,
             row_number() over (partition by k.query_id
                                order by p.created_at desc nulls last, round(k.score, 9) desc, k.tweet_id) as rank
      from k join posts p on p.tweet_id = k.tweet_id)
select {RESULT_COLS}
from h join posts c on c.tweet_id = h.tweet_id where h.rank <= 5
"""

CLEAN = """
clean as (
  select tweet_id, account_id, created_at, username, retweet_count, favorite_count,
         full_text
  from (select *, regexp_replace(full_text, '^\\s+|\\s+$', '', 'g') as stripped from posts)
  where full_text is not null and stripped <> ''
),
qtext as (select * from (values (1, 'the and of'), (2, 'in'), (3, 'zzzz')) t(query_id, query_text))"""

HASHED = f"""
doc_buckets as (
  select tweet_id, bucket, count(*) as c from (
    select tweet_id, cast(('0x' || left(md5(tok), 8))::bigint % 64 as integer) as bucket
    from (select tweet_id, unnest(regexp_extract_all(lower(full_text), '{TOKEN}')) as tok from clean))
  group by tweet_id, bucket
),
dv as (select tweet_id, bucket, cast(c / sqrt(sum(c * c) over (partition by tweet_id)) as float) as w
       from doc_buckets),
q_buckets as (
  select query_id, bucket, count(*) as c from (
    select query_id, cast(('0x' || left(md5(tok), 8))::bigint % 64 as integer) as bucket
    from (select query_id, unnest(regexp_extract_all(lower(query_text), '{TOKEN}')) as tok from qtext))
  group by query_id, bucket
),
qv as (select query_id, bucket, cast(c / sqrt(sum(c * c) over (partition by query_id)) as float) as w
       from q_buckets),
dn as (select c.tweet_id, coalesce(sum(cast(dv.w as double) * cast(dv.w as double)), 0) as dd
       from clean c left join dv on dv.tweet_id = c.tweet_id group by c.tweet_id),
qn as (select q.query_id, coalesce(sum(cast(qv.w as double) * cast(qv.w as double)), 0) as qq
       from qtext q left join qv on qv.query_id = q.query_id group by q.query_id),
dots as (select qv.query_id, dv.tweet_id, sum(cast(qv.w as double) * cast(dv.w as double)) as dot
         from qv join dv on dv.bucket = qv.bucket group by qv.query_id, dv.tweet_id),
knn_all as (
  select qn.query_id, dn.tweet_id,
         1.0 / (1.0 + greatest(dn.dd + qn.qq - 2 * coalesce(dots.dot, 0), 0)) as score
  from qn cross join dn left join dots on dots.query_id = qn.query_id and dots.tweet_id = dn.tweet_id
),
knn_ranked as (
  select *, row_number() over (partition by query_id order by round(score, 9) desc, tweet_id) as rank
  from knn_all
)"""

BM25 = f"""
docs as (select tweet_id, regexp_extract_all(lower(full_text), '{STANDARD}') as toks from clean),
stats as (select count(*) as n, avg(len(toks)) as avgdl from docs),
qt as (select query_id, term, count(*) as qtf from (
         select query_id, unnest(regexp_extract_all(lower(query_text), '{STANDARD}')) as term from qtext)
       group by query_id, term),
tf as (select tweet_id, dl, term, count(*) as tf from (
         select tweet_id, len(toks) as dl, unnest(toks) as term from docs)
       where term in (select term from qt) group by tweet_id, dl, term),
dfq as (select term, count(*) as df from tf group by term),
bm25_all as (
  select qt.query_id, tf.tweet_id,
         sum(qt.qtf * ln(1 + (stats.n - dfq.df + 0.5) / (dfq.df + 0.5))
             * tf.tf / (tf.tf + 1.2 * (1 - 0.75 + 0.75 * tf.dl / stats.avgdl))) as score
  from tf join dfq on dfq.term = tf.term join qt on qt.term = tf.term cross join stats
  group by qt.query_id, tf.tweet_id
),
bm25_ranked as (
  select *, row_number() over (partition by query_id order by round(score, 9) desc, tweet_id) as rank
  from bm25_all
)"""

HYBRID = """
fused as (
  select coalesce(k.query_id, b.query_id) as query_id, coalesce(k.tweet_id, b.tweet_id) as tweet_id,
         coalesce(k.score, 0) as knn_score, coalesce(b.score, 0) as text_score,
         coalesce(k.score, 0) + 0.3 * coalesce(b.score, 0) as score
  from (select * from knn_ranked where rank <= 10) k
  full outer join bm25_ranked b
    on k.query_id = b.query_id and k.tweet_id = b.tweet_id
),
hybrid_ranked as (
  select *, row_number() over (partition by query_id order by round(score, 9) desc, tweet_id) as rank
  from fused
)"""

ORACLES["embed_posts"] = f"""
with {POSTS}, {CLEAN}, {HASHED}
select tweet_id, bucket, round(cast(w as double), 6) as weight from dv
"""

ORACLES["knn_text"] = f"""
with {POSTS}, {CLEAN}, {HASHED}
select query_id, cast(rank as integer) as rank, tweet_id, round(score, 6) as score from knn_ranked where rank <= 5
"""

ORACLES["bm25_match"] = f"""
with {POSTS}, {CLEAN}, {BM25}
select query_id, cast(rank as integer) as rank, tweet_id, round(score, 6) as score from bm25_ranked where rank <= 10
"""

ORACLES["hybrid_search"] = f"""
with {POSTS}, {CLEAN}, {HASHED}, {BM25}, {HYBRID}
select query_id, cast(rank as integer) as rank, tweet_id, round(score, 6) as score,
       round(knn_score, 6) as knn_score, round(text_score, 6) as text_score
from hybrid_ranked where rank <= 5
"""

ORACLES["search_results"] = f"""
with {POSTS}, {CLEAN}, {HASHED}, {BM25}, {HYBRID}
select {RESULT_COLS}
from (select * from hybrid_ranked where rank <= 5) h join clean c on c.tweet_id = h.tweet_id
"""

# ---- cleaning, profiles, ingest ---------------------------------------------

ORACLES["clean_posts"] = f"""
with {POSTS},
dirty as (
  select tweet_id,
         case when cast(tweet_id as bigint) % 17 = 0 then null
              when cast(tweet_id as bigint) % 19 = 0 then '  '
              when cast(tweet_id as bigint) % 23 = 0 then 'NA'
              else full_text end as full_text
  from posts
),
kept as (
  select tweet_id, case when length(stripped) > 10000 then left(stripped, 10000) else full_text end as full_text
  from (select *, regexp_replace(full_text, '^\\s+|\\s+$', '', 'g') as stripped from dirty)
  where full_text is not null and stripped <> ''
)
select tweet_id, cast(length(full_text) as bigint) as n_chars, full_text from kept
"""

_PROFILE_ROW = """
select '{c}' as column, count({c}) as count, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std,
       round(min({c}), 6)::double as min, round(quantile_cont({c}, 0.25), 6) as p25,
       round(quantile_cont({c}, 0.5), 6) as p50, round(quantile_cont({c}, 0.75), 6) as p75,
       round(max({c}), 6)::double as max
from posts"""

ORACLES["post_profile"] = f"""
with {POSTS}
{_PROFILE_ROW.format(c="retweet_count")}
union all
{_PROFILE_ROW.format(c="favorite_count")}
"""

ORACLES["post_time_profile"] = f"""
with {POSTS},
t as (select epoch_us(cast(created_at as timestamp)) as x from posts)
select 'created_at' as column, count(x) as count, make_timestamp(cast(round(avg(x)) as bigint)) as mean,
       make_timestamp(min(x)) as min, make_timestamp(cast(round(quantile_cont(x, 0.25)) as bigint)) as p25,
       make_timestamp(cast(round(quantile_cont(x, 0.5)) as bigint)) as p50,
       make_timestamp(cast(round(quantile_cont(x, 0.75)) as bigint)) as p75, make_timestamp(max(x)) as max
from t
"""

ORACLES["post_preview"] = f"""
with {POSTS}
select tweet_id, cast(created_at as timestamp) as created_at, username, full_text from posts order by tweet_id limit 5
"""

ORACLES["missing_text_filled"] = f"""
with {POSTS}
select tweet_id,
       case when cast(tweet_id as bigint) % 17 = 0 or full_text is null then ''
            when cast(tweet_id as bigint) % 19 = 0 then '  '
            when cast(tweet_id as bigint) % 23 = 0 then 'NA'
            else full_text end as full_text
from posts
"""

_POST_TYPES = [
    ("tweet_id", "string"), ("account_id", "string"), ("created_at", "timestamp"), ("full_text", "string"),
    ("retweet_count", "int"), ("favorite_count", "int"), ("reply_to_tweet_id", "string"),
    ("reply_to_user_id", "string"), ("reply_to_username", "string"), ("username", "string"), ("lang", "string"),
]
_NULL_ROWS = "\nunion all\n".join(
    f"select '{c}' as column, '{t}' as dtype, count({c}) as non_null from posts"
    for c, t in _POST_TYPES
)
ORACLES["null_profile"] = f"""
with {POSTS}
{_NULL_ROWS}
"""

LINES = """
docs as (
  select event_id,
         '{"tweet_id":"' || cast(event_id as varchar) || '","account_id":"' || cast(user_id as varchar)
         || '","created_at":"'
         || case when event_id % 7 = 0 then 'not a date' else strftime(ts, '%Y-%m-%d %H:%M:%S') || '+05:30' end
         || '","full_text":"' || event_type || ' event' || '","retweet_count":'
         || case when event_id % 13 = 0 then '"many"' else cast(cast(floor(value) as bigint) as varchar) end
         || ',"favorite_count":' || cast(event_id % 50 as varchar)
         || ',"username":"user' || cast(user_id as varchar) || '","full_text_vector":['
         || cast(user_id as varchar) || ',' || cast(event_id % 5 as varchar)
         || case when event_id % 17 = 0 then '' else ',1' end || ']}' as doc
  from events
),
lines as (
  select event_id as line_id, case when event_id % 11 = 0 then left(doc, length(doc) - 1) else doc end as value
  from docs
),
tagged as (
  select line_id, value,
         case when not json_valid(value) then 'malformed'
              when value ->> '$.retweet_count' is not null
                   and try_cast(value ->> '$.retweet_count' as integer) is null then 'bad_retweet_count'
              when value ->> '$.favorite_count' is not null
                   and try_cast(value ->> '$.favorite_count' as integer) is null then 'bad_favorite_count'
              when json_array_length(value, '$.full_text_vector') is distinct from 3 then 'bad_vector'
         end as reject_reason
  from lines where trim(value) <> ''
)"""

ORACLES["ingest_accept_reject"] = f"""
with {LINES}
select line_id, reject_reason is null as accepted, reject_reason from tagged
"""

ORACLES["reject_counts"] = f"""
with {LINES}
select reject_reason, count(*) as n from tagged where reject_reason is not null group by reject_reason
"""

ORACLES["created_at_normalized"] = f"""
with {LINES},
acc as (select line_id, value ->> '$.tweet_id' as tweet_id, value ->> '$.created_at' as s
        from tagged where reject_reason is null),
parts as (
  select line_id, tweet_id,
         try_strptime(substr(s, 1, 19), '%Y-%m-%d %H:%M:%S') as local_ts,
         case substr(s, 20, 1) when '+' then 1 when '-' then -1 end
           * (try_cast(substr(s, 21, 2) as integer) * 60 + try_cast(substr(s, 24, 2) as integer)) as off_min
  from acc
)
select line_id, tweet_id,
       strftime(local_ts - to_minutes(off_min), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as created_at
from parts
"""

# exact-mode cell-pruned search must equal the exhaustive answer
ORACLES["ann_topk"] = ORACLES["cosine_topk_batch"]

# the approximate search must reach its recall for every query set of this kind
ORACLES["ann_recall"] = """
select count(*) as n_queries, true as recall_reached from embeddings where vec_id % 100 = 0
"""

ORACLES["ingest_stream_accepted"] = f"""
with {LINES}
select value ->> '$.tweet_id' as tweet_id,
       cast(value ->> '$.retweet_count' as integer) as retweet_count,
       cast(value ->> '$.favorite_count' as integer) as favorite_count
from tagged where reject_reason is null
"""

# ---- sources, clips, cycles and the other search modes ------------------------

_DAILY = ORACLES["daily_word_count"].strip()
ORACLES["daily_word_count_clipped"] = f"""
select * from ({_DAILY}) where day between date '1993-07-01' and date '1996-06-30'
"""

DIRTY = POSTS.replace("posts as (", "whole_posts as (", 1) + """,
posts as (
  select * replace (case when cast(tweet_id as bigint) % 17 = 0 then null
                         when cast(tweet_id as bigint) % 19 = 0 then '  '
                         when cast(tweet_id as bigint) % 23 = 0 then 'NA'
                         else full_text end as full_text)
  from whole_posts
)"""

ORACLES["csv_posts"] = f"""
with {DIRTY}
select tweet_id, account_id, cast(created_at as timestamp) as created_at, full_text,
       case when cast(tweet_id as bigint) % 31 <> 0 then retweet_count end as retweet_count, favorite_count,
       reply_to_tweet_id, reply_to_user_id, reply_to_username, username
from posts where full_text is not null and full_text <> 'NA' and cast(tweet_id as bigint) % 29 <> 0
"""

ORACLES["archive_flat"] = f"""
with {ARCHIVE}
select * exclude (retweeted, part) from (
  select account_id, retweeted, id, full_text, created_at, in_reply_to_user_id, in_reply_to_status_id, pos // 100 as part,
         row_number() over (partition by account_id, pos // 100 order by pos) - 1 as pos
  from archive)
where not retweeted
"""

ORACLES["embed_job"] = f"""
with {DIRTY}, {CLEAN}, {HASHED}
select tweet_id, bucket, round(cast(w as double), 6) as weight from dv
"""

ORACLES["ingest_batch"] = f"""
with {LINES}
select value ->> '$.tweet_id' as tweet_id,
       case when line_id % 7 <> 0
            then strftime(strptime(substr(value ->> '$.created_at', 1, 19), '%Y-%m-%d %H:%M:%S') - to_minutes(330), '%Y-%m')
       end as month,
       cast(value ->> '$.retweet_count' as integer) as retweet_count,
       cast(value ->> '$.favorite_count' as integer) as favorite_count
from tagged where reject_reason is null
"""

LOOPING = ARCHIVE.replace("tw as (select * from archive where not retweeted)", """looping as (
  select * replace (
    case when cast(account_id as bigint) % 10 = 5 and cast(id as bigint) % 100 = 0 then account_id || '02'
         when cast(account_id as bigint) % 10 = 9 and cast(id as bigint) % 100 = 5 then null
         else in_reply_to_status_id end as in_reply_to_status_id,
    case when cast(account_id as bigint) % 10 = 5 and cast(id as bigint) % 100 = 0 then account_id
         else in_reply_to_user_id end as in_reply_to_user_id)
  from archive
),
tw as (select * from looping where not retweeted)""")

# a chain of an account is at most as long as its tweets are many: whoever walks on is in a cycle
ORACLES["thread_roots_cycles"] = f"""
with recursive {LOOPING},
edges as (
  select account_id, id, parent from last_reply l where rn = 1 and parent is not null
    and exists (select 1 from ids i where i.account_id = l.account_id and i.id = l.parent)
),
longest as (select max(n) + 1 as n from (select count(*) as n from ids group by account_id)),
walk(account_id, id, cur, depth) as (
  select account_id, id, id, 0 from ids
  union all
  select w.account_id, w.id, e.parent, w.depth + 1
  from walk w join edges e on e.account_id = w.account_id and e.id = w.cur
  where w.depth < (select n from longest)
)
select account_id, id, max(depth) >= (select n from longest) as is_cycle,
       case when max(depth) < (select n from longest) then arg_max(cur, depth) end as root_id
from walk group by account_id, id
"""


def _fused(score: str) -> str:
    return f"""
with {POSTS}, {CLEAN}, {HASHED}, {BM25},
lists as (
  select coalesce(k.query_id, b.query_id) as query_id, coalesce(k.tweet_id, b.tweet_id) as tweet_id,
         k.score as ks, b.score as ts, k.rank as kr, b.rank as tr
  from (select * from knn_ranked where rank <= 10) k
  full outer join bm25_ranked b
    on k.query_id = b.query_id and k.tweet_id = b.tweet_id
),
bounds as (select query_id, min(ks) as klo, max(ks) as khi, min(ts) as tlo, max(ts) as thi from lists group by query_id),
scored as (select query_id, tweet_id, coalesce(ks, 0) as ks, coalesce(ts, 0) as ts, {score} as score
           from lists join bounds using (query_id)),
ranked as (select *, row_number() over (partition by query_id order by round(score, 9) desc, tweet_id) as rank from scored)
select query_id, cast(rank as integer) as rank, tweet_id, round(score, 6) as score,
       round(ks, 6) as knn_score, round(ts, 6) as text_score
from ranked where rank <= 5
"""


def _scaled(x: str, lo: str, hi: str) -> str:
    return f"(case when {x} is null then 0.0 when {hi} > {lo} then ({x} - {lo}) / ({hi} - {lo}) else 1.0 end)"


ORACLES["hybrid_minmax"] = _fused(f"{_scaled('ks', 'klo', 'khi')} + 0.3 * {_scaled('ts', 'tlo', 'thi')}")
ORACLES["hybrid_rrf"] = _fused("coalesce(1.0 / (60 + kr), 0) + coalesce(1.0 / (60 + tr), 0)")

ORACLES["search_results_knn"] = f"""
with {POSTS}, {CLEAN}, {HASHED}
select {RESULT_COLS}
from (select * from knn_ranked where rank <= 5) h join clean c on c.tweet_id = h.tweet_id
"""

ORACLES["search_results_by_date"] = f"""
with {POSTS}, {CLEAN}, {HASHED},
h as (
  select k.query_id, k.tweet_id, round(k.score, 3) as score,
         row_number() over (partition by k.query_id
                            order by c.created_at desc nulls last, round(k.score, 9) desc, k.tweet_id) as rank
  from knn_ranked k join clean c on c.tweet_id = k.tweet_id where k.rank <= 10
)
select {RESULT_COLS}
from h join clean c on c.tweet_id = h.tweet_id where h.rank <= 5
"""

ORACLES["ingest_stream_twice"] = f"""
with {LINES}
select case when reject_reason is null then value ->> '$.tweet_id' end as tweet_id, reject_reason from tagged
"""

ORACLES["ingest_counters"] = f"""
with {LINES},
c as (select count(*) as total, count(*) - count(reject_reason) as accepted, count(reject_reason) as rejected from tagged)
select cast(1 as bigint) as version, 'first' as batch_id, 'append' as mode, total, accepted, rejected, accepted as stored from c
union all
select 2, 'second', 'dedup', total, accepted, rejected, 0 from c
"""

ORACLES["archive_large"] = f"""
with {ARCHIVE}
select * exclude (retweeted) from (
  select account_id, retweeted, id, full_text, created_at, in_reply_to_user_id, in_reply_to_status_id,
         row_number() over (partition by account_id order by pos) - 1 as pos
  from archive)
where not retweeted
"""

ORACLES["embed_job_resumed"] = ORACLES["embed_job"]
