"""The registered queries of the record-stream operators."""
