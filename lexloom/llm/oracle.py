"""SQL that gives the same rows as a query, where SQL can express it."""

SQL: dict[str, str] = {
    "p7_found": """
        WITH newest AS (
            SELECT doc_id, arg_max(content, parsed_at) AS content FROM parsed_docs GROUP BY doc_id),
        items AS (
            SELECT 'parsed_docs.content' AS field, doc_id, -1 AS seg_index, content FROM newest
            UNION ALL
            SELECT DISTINCT 'segments.content', doc_id, seg_index, content FROM segments)
        SELECT DISTINCT i.field, i.doc_id, i.seg_index
        FROM items i JOIN split_limits l ON l.field = i.field
        WHERE length(i.content) > l.max_chars
    """,
}
