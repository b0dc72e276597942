"""Reading and writing of documents, chunks, snapshots and tenants' exports."""
