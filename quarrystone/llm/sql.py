"""SQL for the queries of the llm subpackage that SQL can express on whole tables."""

SQL: dict[str, str] = {
    "p4_found": r"""
with sized as (
  select c.id,
         length(case when c.kind in ('symbol', 'window')
                     then case when instr(c.text, chr(10)) > 0 then substr(c.text, instr(c.text, chr(10)) + 1) else '' end
                     else c.text end) as n,
         coalesce(o.max_chunk_chars, z.max_chunk_chars) as most
  from code_chunks c left join chunk_options o on o.options_id = coalesce(c.options_id, 0)
  cross join (select max_chunk_chars from chunk_options where options_id = 0) z)
select distinct id from sized where n > most
""",
}
