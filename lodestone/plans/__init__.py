"""The analyses, as queries over fact tables."""
