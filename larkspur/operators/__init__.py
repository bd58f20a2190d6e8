"""Set-at-a-time operators over listings, pages and judgements."""
