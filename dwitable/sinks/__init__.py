"""Writers: output layout, text files, report documents, transfer manifests."""
