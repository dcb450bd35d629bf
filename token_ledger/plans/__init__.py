"""Report bundles and tables on storage."""
