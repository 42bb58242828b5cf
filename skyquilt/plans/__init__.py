"""End-to-end plans: label tree to manifest, catalogs to shortlist, matches to report."""
