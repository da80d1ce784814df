"""Where corpora come from: tables, directory trees, document bytes, CSV bytes."""
