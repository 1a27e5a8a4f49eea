"""Exact inputs and what they must give, stated as they are."""

# Name: kind, consensus bytes, expected identifiers; none for input that must be refused.
OBJECTS = {
    "legacy_transaction": ("transaction", "010000000111111111111111111111111111111111111111111111111111111111111111110000000000ffffffff0188130000000000001976a914222222222222222222222222222222222222222288ac00000000", {"txid": "38bbcabc57b7ab88149ac7143de3c2da113894729da706cf68bc7cec77ce0d78", "wtxid": "38bbcabc57b7ab88149ac7143de3c2da113894729da706cf68bc7cec77ce0d78"}),
    "segwit_v0_transaction": ("transaction", "0200000000010133333333333333333333333333333333333333333333333333333333333333330100000000fdffffff01e80300000000000016001444444444444444444444444444444444444444440201012102555555555555555555555555555555555555555555555555555555555555555500000000", {"txid": "9f969fc01aca0a12933f7d80920ed9fa2ccea2742b1bbdc60b6ed26728c4a1ed", "wtxid": "ee49d957a6d4406b3bff33fa79b84fc456b38eb38d7e2588b92c587e1c3230f9"}),
    "taproot_transaction": ("transaction", "0200000000010166666666666666666666666666666666666666666666666666666666666666660200000000ffffffff01d007000000000000225120777777777777777777777777777777777777777777777777777777777777777701408888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888888800000000", {"txid": "e4ec5782f3a528ac5fe1f316e41c6bd865090e35ce16f20dad99ad74dbdab453", "wtxid": "802f3fd321bbefc67308d60a34708dc962f1f12dfc09a42091c888dbb29289b0"}),
    "coinbase_transaction": ("transaction", "01000000010000000000000000000000000000000000000000000000000000000000000000ffffffff020101ffffffff0100f2052a010000001976a914222222222222222222222222222222222222222288ac00000000", {"txid": "e171bd1212f43336ea013730b2cb758d5a76a20f264d610132caf7b2dcf82b92", "wtxid": "e171bd1212f43336ea013730b2cb758d5a76a20f264d610132caf7b2dcf82b92"}),
    "large_witness": ("transaction", "02000000000101eeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeee0000000000ffffffff01e803000000000000160014444444444444444444444444444444444444444401fd0401aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa00000000", {"txid": "b5801d5f3acae5c1559c600b9c408d42d80654740b5a871ec62a66424cc1214f", "wtxid": "80d2d0bffb3166e2aadb00f173eaa7d7404fa4afc5ff506b3dd7bfd6d5f614b5"}),
    "non_address_script": ("transaction", "010000000199999999999999999999999999999999999999999999999999999999999999990000000000ffffffff010000000000000000066a04deadbeef00000000", {}),
    "reorg_main_1": ("block", "010000000000000000000000000000000000000000000000000000000000000000000000922bf8dcb2f7ca3201614d260fa2765a8d75cbb2303701ea3633f41212bd71e101000000ffff7f20010000000101000000010000000000000000000000000000000000000000000000000000000000000000ffffffff020101ffffffff0100f2052a010000001976a914222222222222222222222222222222222222222288ac00000000", {"block_hash": "c85bb65141c4e6de0b1c0e965b2cd3c3474c35fd5b80c6c8418ad38fd7c3ff53"}),
    "reorg_main_2": ("block", "0100000053ffc3d78fd38a41c8c6805bfd354c47c3d32c5b960e1c0bdee6c44151b65bc8922bf8dcb2f7ca3201614d260fa2765a8d75cbb2303701ea3633f41212bd71e103000000ffff7f20030000000101000000010000000000000000000000000000000000000000000000000000000000000000ffffffff020101ffffffff0100f2052a010000001976a914222222222222222222222222222222222222222288ac00000000", {"block_hash": "5a1fc0d3abf59bd7fd542eac6e87ed5966b2138ac4ffb1224f4fba6afd9fea83"}),
    "truncated_transaction": ("transaction", "010000000111111111111111111111111111111111111111111111111111111111111111110000000000ffffffff0188130000000000001976a91422222222222222222222", None),
    "invalid_compact_size": ("transaction", "01000000fdffff", None),
    "invalid_merkle_block": ("block", "010000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000001000000ffff7f20010000000101000000010000000000000000000000000000000000000000000000000000000000000000ffffffff020101ffffffff0100f2052a010000001976a914222222222222222222222222222222222222222288ac00000000", None),
}
NOTIFICATION = '{"kind":"reorged","old":[{"number":"0x2","hash":"0x0303030303030303030303030303030303030303030303030303030303030303","parentHash":"0x0202020202020202020202020202020202020202020202020202020202020202"}],"new":[{"number":"0x2","hash":"0x0404040404040404040404040404040404040404040404040404040404040404","parentHash":"0x0202020202020202020202020202020202020202020202020202020202020202"}]}'
CHECKPOINT = '{"slot":"0x64","headExecutionPayloadHash":"0x0303030303030303030303030303030303030303030303030303030303030303","safeExecutionPayloadHash":"0x0202020202020202020202020202020202020202020202020202020202020202","finalizedExecutionPayloadHash":"0x0101010101010101010101010101010101010101010101010101010101010101"}'
HEADS = '{"chainId":"0x38","client":"bnb-chain/bsc","head":{"number":"0x2","hash":"0x0303030303030303030303030303030303030303030303030303030303030303","parentHash":"0x0202020202020202020202020202020202020202020202020202020202020202"},"finalized":{"number":"0x1","hash":"0x0202020202020202020202020202020202020202020202020202020202020202","parentHash":"0x0101010101010101010101010101010101010101010101010101010101010101"},"observedAtUnixMs":1721000000000}'
GENESIS = '{"number":"0x0","hash":"0xd4e56740f876aef8c010b86a40d5f56745a118d0906a34e69aec8c0db1cb8fa3","parentHash":"0x0000000000000000000000000000000000000000000000000000000000000000","transactions":[],"source":"eth_getBlockByNumber","capture_scope":"rpc_semantic_subset"}'
MESSAGE = {
    "slot": 434739559,
    "blockhash": "ueCxhj6UkQMrfcuCSyN9eKExhCQWp4Fd4wANiyBKMME",
    "signature": "3QzSaRAdHRC7BzgW8u2QA8K7PPobYd2NgnGprKhPAK11TTnZCxqA9ox6wHsz5tZdFN66bFbaFqvQdKXXj7duwafS",
    "account_keys": [
        "83TSSS7qojPowqrrvH23mCrhEJjnJG2ygaf7FEq9ZgKC",
        "HLixVmXdBqzP1sXT9au4BHcvUjDgx5ev16cEJdd9tUSM",
        "ComputeBudget111111111111111111111111111111",
        "ojh19ojaKduoJZuaJADhcVGp4xt1TcdAvZmpVsCorch"
    ],
    "instructions": [
        {
            "program_id_index": 2,
            "accounts": [],
            "data_base58": "Hfdbhh"
        },
        {
            "program_id_index": 2,
            "accounts": [],
            "data_base58": "3SAiagS7Y52X"
        },
        {
            "program_id_index": 2,
            "accounts": [],
            "data_base58": "UUE8ib"
        },
        {
            "program_id_index": 3,
            "accounts": [
                0,
                1
            ],
            "data_base58": "3D5v7HeR7ApjmZ7mn8HN2uuTwb9k3y57pYTDA23fe7LjYbYWXeEXd4U92dyEP7auoGeNp7pmjvwarDe5K"
        }
    ],
    "logs": [
        "Program ComputeBudget111111111111111111111111111111 invoke [1]",
        "Program ComputeBudget111111111111111111111111111111 success",
        "Program ComputeBudget111111111111111111111111111111 invoke [1]",
        "Program ComputeBudget111111111111111111111111111111 success",
        "Program ComputeBudget111111111111111111111111111111 invoke [1]",
        "Program ComputeBudget111111111111111111111111111111 success",
        "Program ojh19ojaKduoJZuaJADhcVGp4xt1TcdAvZmpVsCorch invoke [1]",
        "Program ojh19ojaKduoJZuaJADhcVGp4xt1TcdAvZmpVsCorch consumed 152 of 202 compute units",
        "Program ojh19ojaKduoJZuaJADhcVGp4xt1TcdAvZmpVsCorch success"
    ],
    "pre_balances": [
        "9703709337",
        "29635680",
        "1",
        "1844441"
    ],
    "post_balances": [
        "9703646353",
        "29635680",
        "1",
        "1844441"
    ],
    "fee": "62984",
    "compute_units_consumed": 602
}
