"""Session logs, catalogs and corpora: readers, checks and writers."""
