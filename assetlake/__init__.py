"""assetlake: DataFrame operators for catalogs, receipts, journals, manifests, ledgers and logs."""
