"""SQL for the queries that SQL can express."""

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
PHRASES = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie", "javascript", "lorem ipsum", "click here", "subscribe",
    "tous droits réservés", "conditions d''utilisation", "politique de confidentialité", "cliquez ici", "mentions légales", "abonnez-vous",
    "todos los derechos reservados", "términos de uso", "política de privacidad", "haga clic aquí", "aviso legal", "suscríbete",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "hier klicken", "impressum", "newsletter abonnieren",
)
WRAPPED = """([^.!?:;…"''”’)\\]\\x20\\x09-\\x0D])[\\x20\\x09]*\\n([a-zß-ÿ])"""
CHARS = f"length(regexp_replace(x, '{SPACE}+', '', 'g'))"

PASSES = f"""(regexp_matches(x, '[.!?:;…"''”’)\\]]{SPACE}*$') or len(regexp_extract_all(x, '[.!?…]{SPACE}')) * 40 >= len(regexp_extract_all(x, '{WORD}'))) and length(x) - length(replace(x, '|', '')) <= 1
 and length(x) - length(translate(x, '#*$%&|<>', '')) <= 0.1 * greatest({CHARS}, 1)
 and len(regexp_extract_all(x, '[!?]{{2,}}')) <= 0.2 * len(regexp_extract_all(x, '{WORD}'))
 and length(x) - length(regexp_replace(lower(x), '{"|".join(PHRASES)}', '', 'g')) <= 0.2 * length(x)"""

OP7 = f"""with w as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{WORD}') w, string_split(coalesce(text, ''), chr(10)) lines, string_split(regexp_replace(coalesce(text, ''), '{WRAPPED}', '\\1 \\2', 'g'), chr(10)) folded from documents),
l as (select doc_id, count(*) - count(distinct x) n_dup from (select doc_id, unnest(lines) x from w) where regexp_matches(x, '[^\\x20\\x09-\\x0D]') group by doc_id),
c as (select doc_id, sum({CHARS}) kept_chars from (select doc_id, unnest(list_distinct(folded)) x from w) where {PASSES} group by doc_id),
g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g from (select doc_id, w, unnest(range(1, len(w) - 1)) i from w)),
p as (select doc_id, count(distinct i + k) n from (select doc_id, i, count(*) over (partition by doc_id, g) c from g), (values (0), (1), (2)) v(k) where c > 1 group by doc_id),
m as (select w.doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint n_symbols,
 coalesce(n_dup, 0)::bigint n_dup_lines, coalesce(p.n, 0)::bigint n_repeat_words, coalesce(kept_chars, 0)::bigint kept_chars from w left join l using (doc_id) left join c using (doc_id) left join p using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and kept_chars >= 0.5 * word_chars kept, kept_chars from b"""

OP10 = f"""with s as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint size, md5('17:' || coalesce(cast(doc_id as varchar), 'null') || ':' || coalesce(text, '')) u from documents),
t as (select source, sum(size)::bigint source_size from s group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0 else 1.0 end weight, source_size * 2.0::double cap from t),
o as (select *, (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
 / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) lvl from w),
f as (select arg_min(lvl, cap / weight) final from o where lvl * weight < cap),
g as (select source, source_size, case when final is null then cap else least(cap, final * weight) end target from w, f),
r as (select s.doc_id, s.size, s.source, g.source_size, g.target, coalesce(sum(size) over (partition by s.source order by u, doc_id, size rows between unbounded preceding and 1 preceding), 0) prior
 from s join g on s.source is not distinct from g.source),
n as (select *, case when source_size > 0 then floor(target / source_size) else 0 end reps from r)
select doc_id, size, source, source_size, target, (reps + case when prior + size / 2.0 <= target - reps * source_size then 1 else 0 end)::int copies,
 ((reps + case when prior + size / 2.0 <= target - reps * source_size then 1 else 0 end) * size)::bigint taken from n"""

OP5 = """with f as (select vec_id, embedding::double[] v from embeddings where vec_id is not null and embedding is not null
 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0), e as (select distinct vec_id, v from f),
 p as (select q.vec_id query_id, q.v, c.vec_id, list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) score from e q join e c on q.vec_id % 50 = 0 and (q.vec_id <> c.vec_id or q.v <> c.v) and len(q.v) = len(c.v)),
 k as (select *, row_number() over (partition by query_id, v order by score desc, vec_id) r from p)
select query_id, r::int as rank, vec_id, score from k where r <= 5"""

#: Windows are compared by their words; the running number of a row stands for the row, since ids may repeat.
OP6 = f"""with w as (select row_number() over () r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') w from documents),
 g as (select r, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) g from (select r, w, unnest(range(1, len(w) - 33)) i from w where len(w) >= 35)),
 t as (select g from g group by g having count(*) > 1), c as (select distinct r, i + k at_ from (select r, i from g semi join t using (g)), range(35) v(k)),
 u as (select r, i, w[i] x from (select r, w, unnest(range(1, len(w) + 1)) i from w)),
 kept as (select r, string_agg(x, ' ' order by i) s from (select u.* from u left join c on u.r = c.r and u.i = c.at_ where c.r is null) group by r), gone as (select r, count(*) n from c group by r)
select doc_id, len(w)::bigint n_words, coalesce(gone.n, 0)::bigint n_removed, sha256(coalesce(s, '')) kept_sha256 from w left join gone using (r) left join kept using (r)"""

OP8 = f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') w from documents),
 s as (select distinct doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from w where len(w) > 0)),
 n as (select doc_id, count(*) n from s group by 1),
 l as materialized (select a.doc_id a, b.doc_id b from s a join s b using (g) where a.doc_id <> b.doc_id group by 1, 2 having 180 * count(*) >= 80 * ((select n from n where doc_id = a.doc_id) + (select n from n where doc_id = b.doc_id))),
 c as (select doc_id node, doc_id root from n union select l.b, c.root from c join l on c.node = l.a)
select w.doc_id, coalesce(n.n, 0)::bigint n_shingles, coalesce(m.root, w.doc_id) component_id from w left join n using (doc_id) left join (select node doc_id, min(root) root from c group by 1) m using (doc_id)"""

ORACLES = {
    "op5_int8_block_neighbours": OP5, "op6_fm_index_dedup": OP6, "op7_line_first_quality": OP7, "op8_heavy_light_jaccard": OP8,
    "op10_capped_water_filling": OP10,
}
