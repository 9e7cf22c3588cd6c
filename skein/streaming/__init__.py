"""Programs as they arrive: new files are analysed batch by batch."""
