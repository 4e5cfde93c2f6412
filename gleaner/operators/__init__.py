"""Steps of curation, each a DataFrame-to-DataFrame function."""
