"""Search operators over key tables (static_rank, sysno, section_id, segment, seqno, term_id)."""
