"""DuckDB SQL of the queries that SQL can express, written on its own."""

from __future__ import annotations

URL_FILTER = """
with seen as (
  select page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages),
hosts as (
  select host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') as domain,
         string_split(host, '.')[-1] as suffix, count(*) as n, sum(l.quality)::double as k
  from seen join labels l on l.doc_id = page_id
  where l.quality is not null and host <> '' group by all),
total as (select coalesce((sum(k) + 1.0) / (sum(n) + 2.0), 0.5) as m0 from hosts),
s0 as (select suffix, sum(n) as n, sum(k) as k, any_value(m0) as m from hosts, total group by suffix),
st_s as (select sum(n * pow(k / n - m, 2)) as spread, sum(m * (1 - m)) as noise,
                sum((n - 1) * m * (1 - m)) as room from s0),
sz_s as (select case when room is null or room <= 0 or spread <= noise then 1000.0
                else least(1000.0, greatest(1.0, (1 - least((spread - noise) / room, 0.999))
                     / ((spread - noise) / room))) end as s from st_s),
s1 as (select suffix, (k + s * m) / ((k + s * m) + (n - k + s * (1 - m))) as mean from s0, sz_s),
d0 as (select domain, h.suffix, sum(n) as n, sum(k) as k, any_value(s1.mean) as m
       from hosts h join s1 on s1.suffix = h.suffix group by domain, h.suffix),
st_d as (select sum(n * pow(k / n - m, 2)) as spread, sum(m * (1 - m)) as noise,
                sum((n - 1) * m * (1 - m)) as room from d0),
sz_d as (select case when room is null or room <= 0 or spread <= noise then 1000.0
                else least(1000.0, greatest(1.0, (1 - least((spread - noise) / room, 0.999))
                     / ((spread - noise) / room))) end as s from st_d),
d1 as (select domain, (k + s * m) / ((k + s * m) + (n - k + s * (1 - m))) as mean from d0, sz_d),
h0 as (select h.host, h.n, h.k, d1.mean as m from hosts h join d1 on d1.domain = h.domain),
st_h as (select sum(n * pow(k / n - m, 2)) as spread, sum(m * (1 - m)) as noise,
                sum((n - 1) * m * (1 - m)) as room from h0),
sz_h as (select case when room is null or room <= 0 or spread <= noise then 1000.0
                else least(1000.0, greatest(1.0, (1 - least((spread - noise) / room, 0.999))
                     / ((spread - noise) / room))) end as s from st_h),
h1 as (select host, k + s * m as a, n - k + s * (1 - m) as b from h0, sz_h),
blocked as (
  select host from h1
  where a / (a + b) + 1.6448536269514722 * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) < 0.5),
ruled as (
  select page_id, host, path,
    case when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1')
           then 'example.org/en/1'
         when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/')
           then 'example.org/es/'
         when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
         when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
         when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/'
    end as rule
  from seen)
select page_id, r.host, path, rule,
       case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
            when b.host is not null then 'block' else 'allow' end as verdict
from ruled r left join blocked b on b.host = r.host
"""

SOURCE_DIVERGENCE = r"""
with d as (
  select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                      'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words
  from documents),
w as (select rid, lang, source, unnest(words) as term from d),
kept as (select lang, term, count(*) as lang_n from w group by all having count(distinct rid) >= 30),
groups as (select distinct lang, source from d),
cells as (select w.lang, w.source, w.term, count(*) as n
          from w join kept k on k.lang = w.lang and k.term = w.term group by all),
langs as (select lang, count(*) as v, sum(lang_n) as n from kept group by all),
totals as (select g.lang, g.source, coalesce((select sum(n) from cells c
                  where c.lang = g.lang and c.source = g.source), 0) + 5 * l.v as total
           from groups g join langs l on l.lang = g.lang),
shares as (select t.lang, t.source, k.term, coalesce(c.n, 0) as n,
                  (1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)::hugeint) // total::hugeint)::bigint as p
           from totals t join kept k on k.lang = t.lang
           left join cells c on c.lang = t.lang and c.source = t.source and c.term = k.term),
whole as (select k.lang, k.term,
                 (1 + (1000000000::hugeint * (lang_n + 5)::hugeint) // (l.n + 5 * l.v)::hugeint)::bigint as q
          from kept k join langs l on l.lang = k.lang),
apart as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
          from shares a join shares b on b.lang = a.lang and b.term = a.term and b.source <> a.source
          group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0)::bigint as value
          from groups a join groups b on b.lang = a.lang and b.source <> a.source
          left join apart x on x.lang = a.lang and x.source = a.source and x.item = b.source),
terms as (select s.lang, s.source, 'term' as part, s.term as item, s.p - h.q as value
          from shares s join whole h on h.lang = s.lang and h.term = s.term where s.n > 0 and s.p > h.q),
ranked as (select *, (row_number() over (partition by lang, source, part
                                         order by value desc, encode(item)))::int as rank
           from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 50
"""

LICENSE_SCAN = r"""
with tpl(template, label, base, text, required) as (values
  (0, 'mit', true, 'under the mit license', 'under the mit license'),
  (1, 'apache-2', true, 'apache license version 2', 'apache license version 2'),
  (2, 'cc-by-nc', true, 'cc by nc', 'cc by nc'),
  (3, 'mit', false, 'permission is hereby granted free of charge to any person obtaining a copy of this software',
   'permission is hereby granted free of charge'),
  (4, 'apache-2', false, 'you may not use this file except in compliance with the license',
   'use this file except in compliance with the license'),
  (5, 'gpl-3', false, 'licensed under the gnu general public license version 3', 'gnu general public license version 3'),
  (6, 'gpl-2', false, 'licensed under the gnu general public license version 2', 'gnu general public license version 2'),
  (7, 'lgpl', false, 'under the terms of the gnu lesser general public license', 'gnu lesser general public license'),
  (8, 'agpl-3', false, 'under the terms of the gnu affero general public license', 'gnu affero general public license'),
  (9, 'bsd', false, 'redistribution and use in source and binary forms with or without modification are permitted',
   'redistribution and use in source and binary forms'),
  (10, 'mpl-2', false, 'subject to the terms of the mozilla public license v 2 0', 'mozilla public license v 2 0'),
  (11, 'isc', false, 'permission to use copy modify and or distribute this software for any purpose',
   'permission to use copy modify and or distribute this software'),
  (12, 'unlicense', false, 'this is free and unencumbered software released into the public domain',
   'free and unencumbered software'),
  (13, 'cc-by', false, 'licensed under a creative commons attribution 4 0 international license',
   'creative commons attribution 4 0 international'),
  (14, 'cc-by-nc', false, 'creative commons attribution noncommercial', 'creative commons attribution noncommercial'),
  (15, 'cc-by-sa', false, 'creative commons attribution sharealike', 'creative commons attribution sharealike'),
  (16, 'cc0', false, 'cc0 1 0 universal', 'cc0 1 0 universal')),
split as (select *, string_split(text, ' ') as tw,
                 len(string_split(trim(split_part(' ' || text || ' ', ' ' || required || ' ', 1)), ' '))
                 - case when trim(split_part(' ' || text || ' ', ' ' || required || ' ', 1)) = '' then 1 else 0 end as k0,
                 len(string_split(required, ' ')) as k from tpl),
cells as (select template, i - 1 as idx, tw[i] as word, (i - 1 >= k0 and i - 1 < k0 + k)::int as need
          from (select *, unnest(range(1, len(tw) + 1)) as i from split)),
d as (select row_number() over () as rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                          'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
w as (select rid, unnest(words) as word, unnest(range(len(words))) as pos from d),
df as (select word, count(distinct rid) as n from w where word in (select word from cells) group by word),
idf as (select c.word, round((1 + ln(((select count(*) from d) + 1) / (coalesce(any_value(df.n), 0) + 1.0))) * 1000000)::bigint
               as weight from cells c left join df on df.word = c.word group by c.word),
whole as (select template, sum(weight) as whole, sum(need) as needed
          from cells join idf on idf.word = cells.word group by template),
met as (select rid, c.template, pos - idx as start, sum(weight) as weight, sum(need) as met
        from w join cells c on c.word = w.word join idf on idf.word = c.word
        where pos >= idx group by all),
place as (select rid, m.template, start, weight::double / whole::double as share, label, base
          from met m join whole h on h.template = m.template join tpl t on t.template = m.template
          where met = needed and weight * 10 >= whole * 8),
found as (select rid, count(*) filter (base) as n_base, min(start) filter (base) as first_word,
                 max(start) filter (base) as last_word,
                 array_to_string(list_sort(list(distinct label) filter (base)), ',') as base_labels,
                 array_to_string(list_sort(list(distinct label)), ',') as labels, max(share) as score
          from place group by rid)
select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word,
       last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
       coalesce(score, 0.0)::double as score
from d left join found f on f.rid = d.rid
"""

ORACLES = {"op8_url_filters": URL_FILTER, "op11_license_scan": LICENSE_SCAN,
           "op12_source_divergence": SOURCE_DIVERGENCE}
