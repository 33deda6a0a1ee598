"""Schemas of the library's tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**fields: str) -> T.StructType:
    return T.StructType([T.StructField(name, T._parse_datatype_string(kind), True) for name, kind in fields.items()])


DDL = {
    "files": "path string, modificationTime timestamp, length bigint, content binary",
    "page_stats": "doc_id bigint, page_no int, text_chars int, n_images int",
    "words": "doc_id bigint, page_no int, word_idx int, text string, x0 double, x1 double, top double, bottom double, page_width double",
    "ocr_lines": "doc_id bigint, page_no int, line_idx int, text string, x double, y double, h double, score double, x0 double, top double, x1 double, bottom double",
    "ocr_pages": "doc_id bigint, page_no int, texts array<string>, scores array<double>, boxes array<array<double>>",
    "rows": "doc_id bigint, row_idx int, cells array<string>",
    "doc_signals": "doc_id bigint, eof_markers int, encrypted boolean, meta_text string, text_sample string, overlay_pages int, fragmented_font_pages int, annotations int",
    "transactions": "account_id bigint, statement_id bigint, txn_idx int, date date, description string, debit decimal(14,2), credit decimal(14,2), balance decimal(14,2)",
    "statements": "user_id int, account_id bigint, statement_id bigint, file_name string, file_hash string, content_hash string, status string, uploaded_at timestamp, confidence double, bank_name string, account_number string, customer_name string, current_balance decimal(14,2), raw_data string",
}

#: What statements.raw_data holds as JSON.
RAW_DATA = "bankName string, accountNumber string, customerName string, currentBalance double, pdfType string, warnings array<string>, confidence double"
